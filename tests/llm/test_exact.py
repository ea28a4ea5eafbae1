"""Operators against brute force on small real tables, and their parts against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from lithoframe.llm import bpe, chat, components, encoder, packing, queries, simhash, suffix_dedup, suffix_sort, token_file

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def labels_of(n, linked):
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_op9(spark, texts):
    def brute(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    fp = {i: brute(t) for i, t in texts.items()}
    want = labels_of(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    got = queries.op9_simhash(spark, DATA).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (fp[i], want[i]) for i in fp}


def test_near_pairs_loses_none(spark):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)]
    for _ in range(300):
        v = fps[rng.integers(len(fps))]
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            v ^= 1 << int(b)
        fps.append(v)
    fps = sorted(set(fps))
    signed = [v - 2**64 if v >= 2**63 else v for v in fps]
    nodes = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    want = {(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2}
    for m in (3, 10):
        rows = simhash.near_pairs(nodes, 2, m).collect()
        assert {(max(r.a, r.b), min(r.a, r.b)) for r in rows} == want and len(rows) == len(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = labels_of({x for e in edges for x in e}, edges)
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_links_are_not_broadcast(spark, monkeypatch):
    """Sides that grow by salts or steps after Spark's estimate would fill the driver's memory."""
    plans = []
    kept = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, "kept")
    written = components.written
    for module in (components, simhash):
        monkeypatch.setattr(module, "written", lambda df, name: kept(df))
    rows = [(i, f"one text {i % 40} of a few words that are much alike") for i in range(200)]
    found = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), limit=6)
    kept(found)
    kept(simhash.near_pairs(spark.createDataFrame([(1, 5), (2, 7)], "id long, fp long")))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_crowded_nodes_are_salted(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 400)] + [(i, 1000 + i) for i in range(1, 400)] + [(5000, 5001)]
    monkeypatch.setattr(components, "HOT", 20)
    monkeypatch.setattr(simhash, "HOT", 20)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == labels_of({x for e in edges for x in e}, edges)
    rows = [(i if i % 9 else None, f"text {i % 3}") for i in range(300)]
    groups = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), limit=0).collect()
    assert len(groups) == 300 and {r.component_id for r in groups} == {1, 2, 3}


def test_op10(spark, texts):
    first, want = {}, {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - 49):
            if first.setdefault(b[j : j + 50], i) < i:
                gone[j] += 1
                gone[j + 50] -= 1
        m = np.cumsum(gone[:-1]) > 0
        want[i] = (len(b), int(m.sum()), int((np.diff(m.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_suffix_dedup(spark, DATA).collect()}
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40) | st.text("ab", min_size=1, max_size=60).map(str.encode), min_size=1, max_size=12), st.sampled_from([3, 20, 255]), st.sampled_from([0, 3, 1 << 20]), st.sampled_from([100, 1 << 20]))
def test_suffix_sort(strings, depth, in_memory, memory):
    text, _ = suffix_sort.joined(strings)
    t = text.tolist()
    got = [(p, s) for a, b in suffix_sort.suffixes_descending(text, depth, memory, in_memory) for p, s in zip(a.tolist(), b.tolist(), strict=True)]
    key = lambda p: t[p : p + depth]
    assert sorted(p for p, _ in got) == list(range(len(t)))
    assert [key(p) for p, _ in got] == sorted(map(key, range(len(t))), reverse=True)
    for (p, _), (q, s) in zip(got, got[1:]):
        n = 0
        while n < depth and max(p, q) + n < len(t) and t[p + n] == t[q + n]:
            n += 1
        assert n == s


def test_queue_files_are_few(tmp_path):
    queue = suffix_sort.BucketQueue(3, 10_000, str(tmp_path), "q")
    tuples = lambda i: (np.array([i], np.int32), np.array([i % 50], np.uint8))
    for i in range(9000):
        queue.push(i % 3, *tuples(i))
    assert queue.files <= 9000 * 5 // 5000 * 3
    for symbol in range(2):
        assert np.concatenate([p for p, _ in queue.chunks(symbol)]).tolist() == list(range(symbol, 9000, 3))
        queue.drop(symbol)
    # What was dropped takes no memory: few tuples more go to no file, each after each.
    queue.drop(2)
    assert queue.held == 0 and not list(tmp_path.iterdir())
    before = queue.files
    for i in range(1000):
        queue.push(0, *tuples(i))
    assert queue.files == before


def test_strings_that_are_alone_share_no_window():
    rng = np.random.default_rng(4)
    letters = lambda n, of=b"ab": bytes(rng.choice(list(of), n).tolist())
    shares = []
    for width, k in ((50, 16), (51, 16), (20, 8)):
        common = [letters(200) for _ in range(20)] + [b"ab" * 100, b"a" * 200]
        texts = [letters(10, b"xyz") + common[i % 22][a : a + n] + letters(10, b"xyz") for i in range(400) for a, n in [(int(rng.integers(0, 120)), int(rng.integers(15, 80)))]]
        data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        value, _, place, n = suffix_dedup.runs(data, ends, width, k)
        strings = list(dict.fromkeys(data[a : a + m + width - 1] for a, m in zip(place.tolist(), n.tolist())))
        has = {}
        for i, s in enumerate(strings):
            for a in range(len(s) - width + 1):
                has.setdefault(s[a : a + width], set()).add(i)
        want = {i for got in has.values() if len(got) > 1 for i in got}
        got = set(np.flatnonzero(suffix_dedup.may_share(strings, width, k)).tolist())
        assert want <= got
        shares.append((len(want), len(got), len(strings)))
    assert all(0 < w and g < n for w, g, n in shares)


def test_shards_are_sorted_in_ranges(spark):
    assert list(suffix_dedup._together(np.array([0, 3, 2, 9, 0, 1, 1]), 5)) == [(0, 3), (3, 4), (4, 7)]
    assert list(suffix_dedup._together(np.zeros(4, int), 5)) == []
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    once, parts = (sorted(map(tuple, suffix_dedup.removed_spans(docs, kept="sha256", shards=1, sort_bytes=n).collect())) for n in (1 << 30, 2000))
    assert once == parts and any(r[2] for r in once)


def test_op3_op5_op2_against_libraries(spark, texts):
    import tiktoken
    from tokenizers import Tokenizer

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.tokenizer("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in queries.op3_bpe(spark, DATA).collect():
        ids = np.array(lib.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    t = Tokenizer.from_file(queries.tokenizer())
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x in texts.items()}
    start = 0
    for r in sorted(queries.op2_token_file(spark, DATA).collect()):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id]))
        start += r.n_tokens
    rows = queries.op5_best_fit_packing(spark, DATA).collect()
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in rows)
    assert sum(r.length for r in rows) == start
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in used.values():
        b.sort()
        assert sum(n for _, n in b) <= 2048 and [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1]]
    assert len(used) <= -(-start // 2048) + 1


PIECES = st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", ".", ",", "1", "é", "中", "'s", "=", "\t", "\x1d", "the", "²", "<|endoftext|>"]), max_size=30).map("".join) | st.text(max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=8))
def test_encoders_equal_their_libraries(texts):
    import tiktoken
    from tokenizers import Tokenizer

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    path, ranks = queries.tokenizer(), queries.tokenizer("byte_bpe_50k.tiktoken")
    t = Tokenizer.from_file(path)
    assert encoder.encoder(path).encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    use = bpe.coder(ranks, public_tokenizers.PATTERN)
    assert use.encode(texts) == [np.array(lib.encode_ordinary(x), "<u4").tobytes() for x in texts]


_PIECES = st.sampled_from(["a", "bé", "C", " ", " ", "  ", "\n", "\n", ".", ",", "\t", "\r", "1", "'s", "-", "<|endoftext|>", "\u0301", "\x85", "中", "😀"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(_PIECES, max_size=14).map("".join), max_size=8))
def test_encoder_on_odd_white_space(texts):
    path = queries.tokenizer()
    use = encoder.encoder(path)
    assert use.encode(texts) == use.library(texts)


def test_runs_are_looked_up_once_a_call():
    class Counted(dict):
        n = 0

        def get(self, *a):
            Counted.n += 1
            return super().get(*a)

        def __getitem__(self, a):
            Counted.n += 1
            return super().__getitem__(a)

    use = encoder.TextEncoder(queries.tokenizer())
    use.known = Counted()
    texts = ["one and the same and one " * 500 + "end\n"] * 4
    assert use.encode(texts) == use.library(texts)
    assert Counted.n < 50
    long = ["a b " * 300_000 + "c", "d e", "", "\t f " * 300_000]
    assert encoder.encode_each(use.encode, long, use.marked) == use.library(long)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=100), st.integers(1, 20))
def test_bits(width, ids, block):
    a = np.array(ids, np.uint64) % (1 << width)
    a = a.astype(np.uint32)
    assert (token_file.unpack_bits(token_file.pack_bits(a, width), len(a), width) == a).all()
    cut = len(a) // 2
    f = token_file.TokenFile(token_file.token_bytes([5, 6], [cut, len(a) - cut], a, width, block))
    assert (f.document(0) == a[:cut]).all() and (f.document(1) == a[cut:]).all()
    assert (f.ids(cut // 2, len(a)) == a[cut // 2 :]).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*chat.MARKS, "\\", "a", "]", " ", "\n"]), max_size=12).map("".join), st.sampled_from(["user", "assistant", "system", "tool", "x]y%", ""]))
def test_chat_round_trip(text, role):
    turns = [(role, text), ("user", text), (role, text)]
    assert [(r, x) for r, x, _, _ in chat.parse("".join(chat.render_turn(r, x)[0] for r, x in turns))] == turns


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=12), st.sampled_from(["norm", "dot"]), st.sampled_from([None, 3]), st.sampled_from([None, 2600]))
def test_plan(counts, rule, docs, attention):
    p = packing.plan(counts, 50, docs, attention, rule)
    bins = {}
    for length, n in counts.items():
        b, o = p.place(np.full(n, length), np.arange(n))
        for x, y in zip(b.tolist(), o.tolist(), strict=True):
            bins.setdefault(x, []).append((y, length))
    assert sorted(bins) == list(range(p.n_bins))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == [0, *np.cumsum([n for _, n in items])[:-1].tolist()]
        assert sum(n for _, n in items) <= 50 and len(items) <= (docs or 50) and sum(n * n for _, n in items) <= (attention or 2500)


def test_packing_is_tight():
    rng = np.random.default_rng(0)
    lengths, n = np.unique(np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
    assert packing.plan(counts, 2048).n_bins <= 1.002 * sum(k * v for k, v in counts.items()) / 2048 + 1


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    for name, label, least in (("op1_quality", "quality", 0.98), ("op8_toxicity", "toxic", 0.95)):
        r = queries.QUERIES[name](spark, "/root/testdata/sf0.1").filter("held_out").join(labels, "doc_id")
        assert r.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least
