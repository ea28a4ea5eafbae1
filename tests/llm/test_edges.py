"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from lithoframe.llm import bpe, chat, exact_dedup, media, packing, quality, simhash, suffix_dedup, token_file, toxicity

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
CLASH = ["keep_id", "group_size", "kept", "recipe", "salt", "score", "fp", "component_id", "id", "size", "length", "part", "ids", "start", "shard", "block", "path", "data", "doc", "starts", "digest"]
LONG = "word another, third. " * 15_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "The same text, twice."), (5, "The same text, twice."), (6, LONG), (7, LONG + "x"), (8, "é🎉 中文 \x00 end"), (9, "a"), (10, "aaaaaaaaaa " * 40), (10, "aaaaaaaaaa " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def text_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_exact_dedup(docs, empty):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == 11
    got = {r.doc_id: r for r in rows}
    assert (got[1].keep_id, got[1].group_size, got[1].kept) == (2, 2, False) and got[2].kept
    assert (got[4].keep_id, got[5].kept) == (5, True) and got[6].keep_id == 6
    assert (got[10].keep_id, got[10].group_size) == (10, 2)
    assert got[6].text_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_with_colliding_keys(spark):
    """Keys of two bits collide all the time; verified identifiers keep texts apart."""
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab. "), rng.integers(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(i, texts[i % 80]) for i in range(120)], "doc_id long, text string")
    for bits in (2, 64):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df, hash_bits=bits, min_chars=5, max_chars=9).collect()}
        for i in range(120):
            same = [j for j in range(120) if texts[j % 80] == texts[i % 80]]
            assert got[i] == (max(same), len(same))


def test_chunks_join_to_the_text(spark):
    texts = [LONG, "no boundary " * 2000, "é" * 5000, "", "a.\nb!c?" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", exact_dedup.chunks_of(F.col("t")).alias("c")).collect():
        assert "".join(r.c) == r.t and all(len(c) <= 4096 for c in r.c)


def test_simhash(docs, empty):
    got = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    assert got[1].fp == got[2].fp == got[3].fp == 0 and got[3].component_id == 1
    assert got[5].component_id == 4 and got[7].component_id == 6
    assert simhash.simhash_groups(empty).count() == 0


def test_suffix(docs, empty):
    unique = docs.dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in suffix_dedup.removed_spans(unique).collect()}
    assert got[1].n_bytes == 0 and got[4].starts == [] and got[6].starts == []
    assert (got[7].starts, got[7].ends, bytes(got[7].kept)) == ([0], [len(LONG)], b"x")
    assert suffix_dedup.removed_spans(empty).count() == 0
    twice = {tuple(r.starts) for r in suffix_dedup.removed_spans(docs.filter("doc_id = 10")).collect()}
    assert twice == {()}


def test_suffix_text_is_valid(spark):
    tail = "©" + "shared tail of the text that is long enough to be found again, surely"
    df = spark.createDataFrame([(1, "x" + tail), (2, "yé" + tail[1:])], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in suffix_dedup.removed_spans(df, kept="text").collect()}
    assert kept == {1: "x" + tail, 2: "y"}


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    docs = docs.unionByName(spark.createDataFrame([(20, "a <|endoftext|> b"), (21, "x<|endoftext|>\n\n<|endoftext|>.  <|endoftext"), (22, LONG * 4 + "<|endoftext|> tail")], "doc_id long, text string"), allowMissingColumns=True)
    want = sorted((i, len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 0], "<u4").tobytes())) for (i, x) in text_of(docs) for e in [t.encode(x, add_special_tokens=False)])
    got = token_file.read_tokens(token_file.write_tokens(docs, JSON, file_ids=20_000)).orderBy("start").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert token_file.read_tokens(token_file.write_tokens(empty, JSON)).count() == 0


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, JSON, capacity=256).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1]] and sum(n for _, n in b) <= 256
    total = sum(r.length for r in rows)
    assert len(bins) == -(-total // 256)
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    assert all(r.length == 256 for r in rows if r.piece > 0)
    assert packing.pack_documents(empty, JSON).count() == 0
    seq = packing.sequences(packing.pack_documents(docs, JSON, capacity=256))
    assert seq.agg(F.sum(F.octet_length("ids"))).first()[0] == 2 * total


def test_bpe(docs, empty):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = sorted(text_of(docs))
    got = sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.bpe_decode(bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect())
    assert got == [(i, np.array(lib.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in texts]
    assert bpe.bpe_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_classifiers(spark, docs, empty):
    rng = np.random.default_rng(2)
    calm = [" ".join(rng.choice(["calm", "words", "here", "plain", "and", "more", "day", "what", "a"], 40)) for _ in range(150)]
    rows = [(t, 0) for t in calm[:100]] + [(t[: 5 * i] + " vilename " + t[5 * i :], 1) for i, t in enumerate(calm[100:])]
    net = toxicity.fit(rows)
    s = toxicity.Scorer(net)
    assert s.score(["what a vilename and more calm words"])[0] > 0.5 > s.score(["what a day and more calm words"])[0]
    far = "calm words here " * 400 + "plain vilename day " + "calm words here " * 400
    assert s.score([far])[0] > 0.5
    for n in (160, 2500):  # in a run without white space
        run = "".join(rng.choice(["calm", "words", "here", "plain", "and", "more", "day", "what"], n // 2))
        assert s.score([run + "vilename" + run])[0] > 0.5 > s.score([run + run])[0]
        assert s.score(["what a day " + run + "vilename" + run + " and more calm"])[0] > 0.5
    got = toxicity.score_toxicity(docs, net).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.with_toxicity(docs, net)
    assert kept.columns == [*[c for c in docs.columns if c != "score"], "score"] and kept.count() == 11
    assert toxicity.score_toxicity(empty, net).count() == 0
    for lone in ([], [("a", 1)], [("a", 0)]):
        assert 0 <= toxicity.Scorer(toxicity.fit(lone)).score(["", "x"])[0] <= 1
    x = np.array([quality.statistics(t) for t, _ in rows])
    assert np.isfinite(x).all() and np.isfinite(quality.statistics("")).all()
    trees = quality.fit(x, np.array([y for _, y in rows], float))
    q = quality.score_quality(docs, trees).collect()
    assert len(q) == 11 and all(0 <= r.score <= 1 for r in q)
    assert quality.score_quality(empty, trees).count() == 0
    for y in (np.zeros(4), np.ones(4)):
        assert 0 <= quality.fit(np.zeros((4, 3)), y).score(np.zeros((1, 3)))[0] <= 1


def test_null_ids(spark):
    shared = "a text that is certainly long enough to be found again in another one"
    df = spark.createDataFrame([(None, shared), (None, shared), (3, shared), (4, "x"), (None, "y")], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(df).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in rows) == [(0, 0, 1, True), (0, 3, 3, False), (0, 3, 3, False), (3, 3, 3, True), (4, 4, 1, True)]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.simhash_groups(df).collect()) == [(0, 0), (0, 3), (0, 3), (3, 3), (4, 4)]
    got = sorted((r.doc_id or 0, bytes(r.kept)) for r in suffix_dedup.removed_spans(df).collect())
    assert got == [(0, b""), (0, b""), (0, b"y"), (3, shared.encode()), (4, b"x")]
    assert [r.doc_id for r in token_file.read_tokens(token_file.write_tokens(df, JSON)).orderBy("start").collect()] == [None, None, None, 3, 4]
    assert packing.pack_documents(df, JSON).count() == 5
    assert bpe.bpe_digests(df, RANKS, public_tokenizers.PATTERN).count() == 5
    trees = quality.fit(np.array([quality.statistics(x) for x in ("a b", "c d. e")]), np.array([0.0, 1.0]))
    assert quality.score_quality(df, trees).filter("doc_id is null and score is not null").count() == 3
    net = toxicity.fit([("a b", 0), ("c d", 1)])
    assert toxicity.score_toxicity(df, net).filter("doc_id is null and score is not null").count() == 3
    largest = spark.createDataFrame([(2**63 - 1, shared), (1, shared), (None, "z" + shared)], "doc_id long, text string")
    assert {(r.doc_id, bytes(r.kept)) for r in suffix_dedup.removed_spans(largest).collect()} == {(2**63 - 1, b""), (1, shared.encode()), (None, b"z")}


def test_a_very_long_text(spark):
    from tokenizers import Tokenizer

    long = "some words, then more. " * 140_000
    df = spark.createDataFrame([(1, long), (2, "z" * 3_000_000)], "doc_id long, text string")
    spans = {r.doc_id: (r.starts, r.n_bytes) for r in suffix_dedup.removed_spans(df, kept="sha256").collect()}
    assert spans == {1: ([], len(long)), 2: ([], 3_000_000)}
    t = Tokenizer.from_file(JSON)
    n = len(t.encode(long, add_special_tokens=False).ids)
    got = {r.doc_id: r.n_tokens for r in token_file.read_tokens(token_file.write_tokens(df.filter("doc_id = 1"), JSON)).collect()}
    assert got == {1: n + 1}
    ids = np.array(t.encode(long, add_special_tokens=False).ids, "<u4").tobytes()
    digest = bpe.bpe_digests(df.filter("doc_id = 1"), RANKS, public_tokenizers.PATTERN).first()
    assert (digest.n_tokens, digest.ids_sha256, digest.decoded_sha256) == (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(long.encode()).hexdigest())
    pieces = packing.pack_documents(df.filter("doc_id = 1"), JSON).collect()
    assert sum(r.length for r in pieces) == n + 1 and all(zlib.crc32((ids + bytes(4))[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in pieces)
    trees = quality.fit(np.array([quality.statistics(x) for x in ("a b", "c d. e")]), np.array([0.0, 1.0]))
    assert quality.score_quality(df, trees).count() == toxicity.score_toxicity(df, toxicity.fit([("a b", 0), ("c d", 1)])).count() == 2
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn int, role string, text string")
    got = chat.chat_digests(chat.format_chats(turns)).first()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())
    assert simhash.simhash_groups(df).count() == exact_dedup.exact_dedup(df).count() == 2


def test_chat(spark):
    said = "</s>[INST] ok [/INST]\\ [ROLE:x] [/SYS] tail \\"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "tool]%", said), (1, 3, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, 5, "system", "s"), (3, 1, "user", "u")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("segment", F.lit("clash"))
    for chars in (1, 1 << 20):
        got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(turns, chars)).collect()}
        for c in (1, 2, 3):
            own = sorted([(t, r or "", x or "") for i, t, r, x in rows if i == c])
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
            loss = "".join(x for _, r, x in own if r == "assistant")
            assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(turns.limit(0)).count() == 0
    bare = chat.chat_digests(chat.format_chats(spark.createDataFrame([(None, 1, "user", "b"), (None, None, "user", "a"), (4, None, "assistant", "c")], turns.drop("segment").schema))).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.turns_sha256) for r in bare) == [(0, 2, hashlib.sha256(b"user\na\nuser\nb\n").hexdigest()), (4, 1, hashlib.sha256(b"assistant\nc\n").hexdigest())]


def test_a_very_long_conversation(spark):
    """It is rendered by ranges of its turns and read back in order."""
    turns = spark.range(20_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), "id", F.lit(" </s>")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows meet in one task
    try:
        made = chat.format_chats(turns.union(turns.limit(5).withColumn("conv_id", F.lit(8).cast("long"))), 4096)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert made.filter("conv_id = 7").select((F.col("segment") / 2**32).cast("int")).distinct().count() > 1
    got = chat.chat_digests(made).filter("conv_id = 7").first()
    said = [(("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(20_000)]
    assert (got.n_turns, got.turns_sha256) == (20_000, hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest())
    assert got.loss_sha256 == hashlib.sha256("".join(x for r, x in said if r == "assistant").encode()).hexdigest()


def test_chat_events(spark):
    e = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "Hel"), (1, 1, 3, "delta", None, "lo"), (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "Bye"), (1, 0, 6, "edit", None, "hey"), (1, 2, 7, "message", "user", "gone"), (1, 2, 8, "delete", None, None), (2, 0, 0, "delta", "assistant", "x")]
    got = chat.fold_events(spark.createDataFrame(e, "conv_id long, message long, seq long, kind string, role string, text string")).orderBy("conv_id", "message").collect()
    assert [(r.conv_id, r.message, r.role, r.text) for r in got] == [(1, 0, "user", "hey"), (1, 1, "assistant", "Bye"), (2, 0, "assistant", "x")]


def test_media(spark):
    rng = np.random.default_rng(0)

    def image():
        wave = np.cos(np.pi * np.arange(8, 16)[:, None] * (np.arange(120) + 0.5)[None, :] / 100)
        a = wave.T @ rng.standard_normal((8, 8)) @ wave
        return np.clip(128 + 40 * a / a.std(), 0, 255)

    rows = [(90, None), (91, None), (92, b"junk"), (93, b"junk"), (94, b"")]
    for i in range(6):
        a = image()
        rows += [(10 * i + j, media.encode_pgm(v)) for j, v in enumerate((a, a, a[10:110, 5:100], np.clip(a * 0.8 + 20, 0, 255)))]
    df = spark.createDataFrame(rows, "image_id long, image binary").withColumn("digest", F.lit(1)).withColumn("links", F.lit(1))
    got = {r.image_id: r.component_id for r in media.image_copies(df).collect()}
    assert len(got) == len(rows) and got[90] == 90 and got[91] == 91 and got[93] == 92
    found = [got[10 * i + j] == 10 * i for i in range(6) for j in (1, 2, 3)]
    assert np.mean(found) >= 0.9 and all(got[10 * i + j] // 10 == i for i in range(6) for j in range(4))
    assert {r.image_id: r.component_id for r in media.image_copies(df, most=2, crowd=1).collect()} == got
    assert media.image_copies(df.limit(0)).count() == 0


def test_png(spark):
    a = (np.arange(12 * 9).reshape(12, 9) * 7 % 256).astype(np.uint8)
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    lines, before = b"", np.zeros(9, int)
    for y, row in enumerate(a.astype(int)):
        kind = y % 5
        left = np.concatenate([[0], row[:-1]])
        corner = np.concatenate([[0], before[:-1]])
        p = left + before - corner
        near = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [np.zeros(9, int), left, before, (left + before) // 2, near][kind]
        lines += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (9).to_bytes(4, "big") + (12).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (media.decode_image(png) == a).all()
    assert media.decode_image(png[:40]) is None and media.decode_image(b"P5 9 9 255\n12") is None
