"""Each stage of the corpus pipeline against a plain version on the stage's own input."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lithoframe.llm import queries, toxicity
from lithoframe.llm.exact_dedup import exact_dedup
from lithoframe.llm.simhash import fingerprint

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, DATA, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    kept = []
    for name, stage in pipeline.STAGES:
        out = pipeline.written(stage(spark, docs, DATA), name)
        kept.append({r[0]: r for r in out.collect()} if name != "packing" else out.collect())
        if name != "packing":
            assert out.columns == columns
        docs = out
    toxic, exact, near, cut, packed = kept

    net = toxicity.train_toxicity(queries.table(spark, DATA, "documents"), queries.table(spark, DATA, "labels"))
    ids = list(rows)
    scores = dict(zip(ids, toxicity.Scorer(net).score([rows[i].text for i in ids]), strict=True))
    assert set(toxic) == {i for i in ids if scores[i] < 0.5}

    last = {}
    for i in toxic:
        last[toxic[i].text] = max(i, last.get(toxic[i].text, i))
    assert set(exact) == set(last.values())

    fp = {i: fingerprint(exact[i].text) for i in exact}
    group = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if group[b] < group[a] and (fp[a] ^ fp[b]).bit_count() <= 2:
                    group[a], changed = group[b], True
    assert set(near) == {i for i in fp if group[i] == i}

    first = {}
    assert set(cut) == set(near)
    for i in sorted(near):
        b = near[i].text.encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first.setdefault(b[j : j + 50], i) < i:
                gone[j : j + 50] = True
        want = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
        assert (cut[i].text, cut[i].n_chars, cut[i].lang) == (want, len(want), near[i].lang)

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    own = {i: np.array([*t.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for i, r in cut.items()}
    assert {r.doc_id for r in packed} == set(cut) and sum(r.length for r in packed) == sum(map(len, own.values()))
    assert all(zlib.crc32(own[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in packed)
    assert hashlib.sha256(b"").hexdigest()


def test_run(spark):
    assert pipeline.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


ROWS = [
    (1, "the first text that is long enough to be found in another text again, word by word", "en"),
    (2, "a text of its own", None),
    (2, "other text under the same id", "en"),
    (2, "a text of its own", None),
    (None, "a text without an id", "en"),
    (None, "a text without an id", "en"),
    (3, "a text without an id", "en"),
    (4, None, "en"),
    (5, "", "en"),
    (6, "more. the first text that is long enough to be found in another text again, word by word", "de"),
    (7, "end. " * 60_000, "en"),
]


def own_docs(spark, path=None):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for c in ("row", "row_", "kept", "keep_id", "toxicity_score", "member", "of", "starts", "component_id", "_metadata"):
        df = df.withColumn(c, F.concat(F.lit("x"), F.monotonically_increasing_id()))
    if path:
        df.repartition(3).write.parquet(path)
        return spark.read.parquet(path)
    return df


@pytest.mark.parametrize("from_files", [True, False])
def test_stages_tell_rows_apart(spark, tmp_path, from_files):
    """Rows that repeat an id or have none, null and empty texts, clashing columns, no ``n_chars``."""
    docs = own_docs(spark, str(tmp_path / "docs") if from_files else None)
    got = pipeline.toxicity(spark, docs, DATA)
    assert got.columns == docs.columns
    got = pipeline.exact(spark, docs, DATA)
    assert got.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted((i or 0, (t or "")[:24]) for i, t in rows) == sorted([(1, ROWS[0][1][:24]), (2, ROWS[1][1][:24]), (2, ROWS[2][1][:24]), (3, ROWS[4][1][:24]), (5, ""), (6, ROWS[9][1][:24]), (7, ROWS[10][1][:24])])
    got = pipeline.near(spark, docs, DATA)
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == docs.columns and sorted((i or 0, (t or "")[:24]) for i, t in rows) == sorted([(1, ROWS[0][1][:24]), (2, ROWS[1][1][:24]), (2, ROWS[2][1][:24]), (3, ROWS[4][1][:24]), (4, ""), (6, ROWS[9][1][:24]), (7, ROWS[10][1][:24])])
    got = pipeline.substrings(spark, docs, DATA)
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == docs.columns
    assert sorted((i or 0, t is None, (t or "")[:24]) for i, t in rows) == sorted((i or 0, t is None, (t or "")[:24] if i != 6 else "more. ") for i, t, _ in ROWS)
    assert pipeline.packing(spark, docs, DATA).select("doc_id").count() >= len(ROWS)


def test_stages_of_an_empty_table(spark, tmp_path):
    queries.table(spark, DATA, "documents").limit(0).write.parquet(str(tmp_path / "none"))
    docs = spark.read.parquet(str(tmp_path / "none"))
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_near_broadcasts_no_rows(spark, monkeypatch):
    plans, written = {}, pipeline.written
    monkeypatch.setattr(pipeline, "written", lambda df, name, *a: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and written(df, name, *a))
    pipeline.near(spark, queries.table(spark, DATA, "documents"), DATA).count()
    plan = plans["dropped"]
    assert "SortMergeJoin" in plan
    assert plan.count("BroadcastExchange") == plan.count("Scan ExistingRDD[row_path")  # the files' numbers


def test_substrings_broadcast_no_texts(spark):
    """An estimate from the marks, which are few where little repeats, broadcast all texts while the query ran."""
    out = pipeline.substrings(spark, queries.table(spark, DATA, "documents"), DATA)
    out.collect()
    ran = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "SortMergeJoin" in ran
    assert ran.count("BroadcastHashJoin") == 2  # the files' numbers, for the texts and for the other columns


def test_exact_dedup_broadcasts_no_salted_groups(spark):
    """An estimate from the groups before their salts broadcast each 64 times."""
    plan = exact_dedup(queries.table(spark, DATA, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
