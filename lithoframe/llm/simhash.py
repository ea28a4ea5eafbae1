"""Near-duplicates by SimHash: a grid join over the bit counts of fingerprint segments.

Cut a 64-bit fingerprint into segments and map it to the number of set bits in
each. Flipping a bit moves one coordinate by one, so the Manhattan distance of
two such points is at most the Hamming distance of their fingerprints. Points
within the limit lie in cells whose offset is one of a fixed set; each pair
meets by exactly one of two opposite offsets, and the exact distance decides.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import crowded, keyed_text, lean, salt_of, salted, sliced, written
from lithoframe.llm.components import HOT, components

HASH_SEED = 42


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of a text: A-Z in lower case, words between ASCII white space, ``width``-word shingles with repeats."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    ends = (np.cumsum([len(w) for w in words]) + np.arange(n)).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_digest
    n -= width - 1
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        hashes = b"".join([digest(joined[s:e], HASH_SEED) for s, e in zip(starts[at:to], ends[at + width - 1 : to + width - 1], strict=True)])
        count += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""

    def run(batches):
        for batch in sliced(batches, 512):
            found = np.array([fingerprint(t or "", width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return keyed_text(df, id_col, text_col).mapInArrow(lean(run), "doc_id long, fp long")


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``m`` segments of 64 bits, as even as can be."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def offsets(m: int, limit: int) -> list[tuple[int, ...]]:
    """One of each two opposite integer vectors within Manhattan distance ``limit``, and zero."""
    out = {(0,) * m}
    for _ in range(limit):
        out |= {(*v[:i], v[i] + d, *v[i + 1 :]) for v in out for i in range(m) for d in (1, -1)}
    return sorted(v for v in out if v >= (0,) * m)


def segment_count(n: int, limit: int, least: int = 10, most: int = 21, aim: float = 16.0) -> int:
    """The fewest segments for which a fingerprint meets about ``aim`` others by chance, among ``n`` random ones."""
    for m in range(least, most):
        same = sum(math.log2(math.comb(2 * w, w)) - 2 * w for _, w in segments(m))
        if len(offsets(m, limit)) * n * 2.0**same <= aim:
            return m
    return most


def near_pairs(nodes: DataFrame, limit: int = 2, m: int = 10) -> DataFrame:
    """Pairs (``a``, ``b``) of ids of different fingerprints within ``limit`` bits. ``nodes``: ``id``, ``fp``, each fingerprint once."""
    parts = segments(m)
    # Digits have room for ``limit`` on both sides, so an offset never carries into the next digit.
    radix = [math.prod(w + 1 + 2 * limit for _, w in parts[:i]) for i in range(m)]
    cell: Column = F.lit(0).cast("long")
    for (shift, bits), r in zip(parts, radix, strict=True):
        cell = cell + F.bit_count(F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << bits) - 1))).cast("long") * F.lit(r).cast("long")
    steps = [sum(d * r for d, r in zip(v, radix, strict=True)) for v in offsets(m, limit)]
    placed = nodes.select("id", "fp", cell.alias("cell"))
    step = F.explode(F.lit(np.array(steps, np.int64)))
    probes = placed.select(F.col("fp").alias("fp_a"), F.col("id").alias("a"), "cell", step.alias("step")).select("fp_a", "a", (F.col("cell") + F.col("step")).alias("cell"), (F.col("step") == 0).alias("own"))
    # A sort-merge join spills, and large cells can be split while it runs; either side would be broadcast by an estimate that doesn't know the steps.
    met = probes.hint("merge").join(placed.withColumnRenamed("id", "b"), "cell")
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp"))) <= limit
    return met.filter(near & (~F.col("own") | (F.col("fp_a") < F.col("fp")))).select("a", "b")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 2, salts: int = 32, m: int | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``fp``, ``component_id`` (the least id reachable over links).

    Documents link when their fingerprints differ in ``limit`` bits or fewer.
    Documents with one fingerprint are one node, however many they are. A null
    or empty text, or one of white space only, has fingerprint zero and links
    like any other. An id that repeats is one document: its rows link. A row
    without an id gets the component of its fingerprint if others with an id
    share it, else NULL. Other
    columns play no part; an empty table gives no rows. No pair is capped or
    left out; ``m`` sets the number of segments, which changes only the work.
    """
    prints = written(fingerprints(df, id_col, text_col, width), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("size")), "nodes")
    n, rows = nodes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    links = near_pairs(nodes.select("id", "fp"), limit, m or segment_count(n, limit))
    found = components(links, "a", "b")
    labelled = nodes.join(found.hint("merge"), nodes.id == found.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"), "id", "size")
    hot = crowded(nodes, "fp", "size", max(HOT, rows // 1000))
    shared = salted(labelled.filter("size > 1 or component_id <> id").select("fp", "component_id"), "fp", hot, salts)
    joined = prints.withColumn("salt", F.when(F.col("fp").isin(hot), salt_of("doc_id", salts)).otherwise(0)).join(shared.hint("merge"), ["fp", "salt"], "left")
    return joined.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def fingerprint_hex(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
