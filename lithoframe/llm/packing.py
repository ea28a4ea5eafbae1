"""Best-fit packing of documents into sequences, over counts of lengths.

Items of one length are alike, so packing needs only how many there are of
each: at most ``capacity`` numbers, whatever the corpus. ``plan`` packs those
counts by vector best-fit: a bin has a residual in tokens, documents and
attention cost (the sum of squared lengths), an item takes from all three, and
of the bins where it fits, the one with the best score takes it. Bins with the
same content are one entry with a multiplicity. Items then find their place by
their rank among the items of their length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.llm.common import keyed_text, lean, sliced, written
from lithoframe.llm.encoder import CHARS, ROWS, encode_each, encoder, in_groups


@dataclass
class Plan:
    """For each length, runs of ranks: where a run starts, its first bin, its items a bin, and its offset in a bin."""

    n_bins: int
    runs: dict[int, np.ndarray]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of items."""
        bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        values, first = np.unique(length[order], return_index=True)
        for value, i, j in zip(values, first, [*first[1:], len(order)], strict=True):
            rows, runs = order[i:j], self.runs[int(value)]
            r = runs[np.searchsorted(runs[:, 0], rank[rows], side="right") - 1]
            at = rank[rows] - r[:, 0]
            bins[rows] = r[:, 1] + at // r[:, 2]
            offsets[rows] = r[:, 3] + at % r[:, 2] * int(value)
        return bins, offsets


def plan(counts: dict[int, int], capacity: int, max_docs: int | None = None, max_attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> Plan:
    """Vector best-fit decreasing over counts of lengths.

    ``rule`` is ``norm`` (the least weighted norm of what would be left) or
    ``dot`` (the largest weighted product of item and residual). All three
    capacities hold in every bin. Ties go to the bin that was opened first.
    """
    limit = np.array([capacity, max_docs or capacity, max_attention or capacity * capacity], np.int64)
    scale = np.asarray(weights) / limit
    room = np.zeros((1024, 3), np.int64)
    many = np.zeros(1024, np.int64)
    content: list[list[tuple[int, int]]] = []

    def add(left: np.ndarray, n: int, items: list[tuple[int, int]]) -> None:
        nonlocal room, many
        if len(content) == len(many):
            room, many = np.concatenate([room, np.zeros_like(room)]), np.concatenate([many, np.zeros_like(many)])
        room[len(content)], many[len(content)] = left, n
        content.append(items)

    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        item, n = np.array([length, 1, length * length], np.int64), int(counts[length])
        if (item > limit).any():
            raise ValueError(f"an item of {length} tokens fits no bin")
        while n:
            k = len(content)
            fits = np.flatnonzero((many[:k] > 0) & (room[:k] >= item).all(axis=1))
            if len(fits):
                left = room[fits]
                score = -(((left - item) * scale) ** 2).sum(axis=1) if rule == "norm" else (left * item * scale * scale).sum(axis=1)
                best = int(fits[np.argmax(score)])
                from_room, from_many, items = room[best].copy(), int(many[best]), content[best]
            else:
                best, from_room, from_many, items = -1, limit, n, []
            each = int(min((from_room // np.maximum(item, 1)).min(), n))
            taken = min(from_many, n // each)
            add(from_room - each * item, taken, [*items, (length, each)])
            if best >= 0:
                many[best] -= taken
            n -= taken * each

    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    bins = 0
    for items, n in zip(content, many[: len(content)].tolist(), strict=True):
        offset = 0
        for length, each in items if n else []:
            runs.setdefault(length, []).append((used.get(length, 0), bins, each, offset))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        bins += n
    return Plan(bins, {k: np.array(v, np.int64) for k, v in runs.items()})


def cut(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: only more than ``longest`` are cut, and only the first piece may be shorter."""
    first = n % longest or min(n, longest)
    return [(0, first), *((s, longest) for s in range(first, n, longest))]


def encode_pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all texts with their ids, written once: ``doc_id, piece, start, length, ids`` and ``part, local_rank``, which number the pieces of a length within a part."""
    def encode(batches):
        coder, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        kind = "<u2" if max(coder.vocab_size, end_id + 1) <= 1 << 16 else "<u4"
        seen = np.zeros(longest + 1, np.int64)
        end = int(end_id).to_bytes(4, "little")
        for batch in sliced(batches, ROWS):
            for keys, texts in in_groups(batch.column(0).to_pylist(), batch.column(1).to_pylist(), CHARS):
                rows = []
                for key, got in zip(keys, encode_each(coder.encode, texts, coder.marked), strict=True):
                    ids = np.frombuffer(got + end, "<u4").astype(kind)
                    for piece, (start, length) in enumerate(cut(len(ids), longest)):
                        rows.append((key, piece, start, length, part, int(seen[length]), ids[start : start + length].tobytes()))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "part", "local_rank", "ids"])

    made = keyed_text(df, id_col, text_col).mapInArrow(lean(encode), "doc_id long, piece int, start long, length long, part long, local_rank long, ids binary")
    return written(made, "pieces")


def best_fit(items: DataFrame, capacity: int = 2048, sizes: DataFrame | None = None, **constraints) -> DataFrame:
    """``items`` (with ``length, part, local_rank``) plus ``sequence_id`` and ``offset``.

    The driver gets one count per length. Offsets of a part's ranks come from
    counts per part and length, joined on both, so no length is a hot key.
    ``sizes`` has the items' ``part`` and ``length`` where they are cheaper to
    read than ``items``.
    """
    spark = items.sparkSession
    counts = (items if sizes is None else sizes).groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    base = counts.select("part", "length", before.alias("base"))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan(totals, capacity, **constraints))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        bins, offsets = shared.value.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    placed = items.join(base, ["part", "length"]).withColumn("at", place("length", F.col("base") + F.col("local_rank")))
    return placed.select(*items.columns, "at.sequence_id", "at.offset")


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = True, **constraints) -> DataFrame:
    """Encode, cut and pack all texts: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids``.

    A null text is empty and packs as ``end_id`` alone; rows that repeat an id
    are packed each; other columns play no part; an empty table gives no rows.
    ``max_docs`` and ``max_attention`` bound a sequence's documents and summed
    squared lengths; by default neither binds.
    """
    pieces = encode_pieces(df, tokenizer_path, id_col, text_col, capacity, end_id)

    def digest(batches):
        for batch in sliced(batches, 2048):
            wide = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype("<u4") for x, n in zip(batch.column(6).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = [*batch.columns[:6], pa.array([zlib.crc32(x) for x in wide], pa.int64()), *([batch.column(6)] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "part", "local_rank", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = "doc_id long, piece int, start long, length long, part long, local_rank long, ids_crc32 long" + ", ids binary" * with_ids
    return best_fit(pieces.mapInArrow(lean(digest), schema), capacity, pieces, **constraints).drop("part", "local_rank")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``doc_ids`` and ``lengths`` by place, and ``ids`` joined. A group has at most the capacity's items."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"), joined.alias("ids"))
