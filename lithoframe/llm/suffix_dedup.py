"""Substring dedup across documents by suffix sorting in shards.

A window is ``width`` bytes of a document. Its minimizer, the least hash of its
``k``-byte strings, depends on its bytes only, so equal windows have equal
minimizers. Consecutive windows with one minimizer are a run. The steps:

1. Blocks of documents are written to the shared folder; each block sends the
   hashes of its minimizers, 32 bits each, to the shard that their range names.
2. A shard tells each block which of them another document has too.
3. Each block sends the bytes of those runs to their shards, each distinct
   string once with the least id of its documents.
4. A shard sorts all suffixes of its strings, some megabytes of them at a time
   by ranges of their minimizers, and tells each block, for each window of its
   strings, the least id of a document that has it. A string whose minimizer no
   other has within a half window's bytes shares no window, and isn't sorted.
5. Each block marks the windows that a smaller id has, and cuts their bytes.

Only hashes, marks and strings that repeat cross the network; texts stay in
their block. A passage that very many documents share is one string of each
block, whatever their number.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import fresh_path, keyed_text, lean, sliced
from lithoframe.llm.suffix_sort import least_owner
from lithoframe.llm.token_file import file_system, put

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
SLICE = 1 << 16
RANGES = 32
NO_ID = np.iinfo(np.int64).max
ROW = "shard int, block long, path string, kind int, data binary"
ROW_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("path", pa.string()), ("kind", pa.int32()), ("data", pa.binary())])


def _hashes(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixed words of 8 bytes from each place on, and hashes of the ``k`` bytes there; bytes beyond the data are 0."""
    n = len(data)
    x = np.ndarray((n + k - 8,), "<u8", buffer=data + bytes(64), strides=(1,)).copy()
    x *= _A
    x ^= x >> np.uint64(29)
    h = x[:n].copy()
    for j in range(8, k, 8):
        h *= _B
        h ^= h >> np.uint64(31)
        h += x[j : n + j]
    h *= _C
    h ^= h >> np.uint64(32)
    return x, h


def runs(data: bytes, ends: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of documents that follow each other in ``data``: minimizer, document, first window, number of windows.

    ``ends`` are the documents' ends; the last may lie beyond ``data``.

    A run has at most as many windows as a window has ``k``-byte strings, so a
    run's bytes are bounded where a text repeats one string. ``k`` is a
    multiple of 8.
    """
    n, span = len(data), width - k + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none.astype(np.uint64), none, none, none
    h = _hashes(data, k)[1]
    size = 1
    while size * 2 <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if size < span:
        h = np.minimum(h[: size - span], h[span - size :])
    h = h[: n - width + 1]
    lengths = np.diff(np.minimum(ends, n), prepend=0)
    doc = np.repeat(np.arange(len(ends)), lengths)[: len(h)]
    place = np.flatnonzero(np.arange(len(h)) + width <= ends[doc])
    if not len(place):
        return none.astype(np.uint64), none, none, none
    # Least hashes crowd at the low end; mixed anew they are even, and equal where they were.
    value, doc = h[place] * _A, doc[place]
    value ^= value >> np.uint64(32)
    value *= _C
    at = np.arange(len(place))
    new = np.ones(len(place), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    begin = np.flatnonzero(since % span == 0)
    return value[begin], doc[begin], place[begin], np.diff(begin, append=len(place))


def may_share(strings: list[bytes], width: int, k: int) -> np.ndarray:
    """Whether each of some distinct strings of runs may share a window with another; if not, none of its windows is in another.

    A window has its string's minimizer, and holds half of its other bytes, or
    more, on one side of it. So strings that share a window agree on these
    bytes at least, on the left or on the right. Where a minimizer is in a
    string twice, all strings that have it count.
    """
    half = (width - k) // 2
    found = []
    size = np.cumsum([len(s) for s in strings])
    cuts = [0, *(np.flatnonzero(np.diff(size >> 20)) + 1).tolist(), len(strings)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # slices stay near the processor
        lengths = np.diff(size[a:b], prepend=size[a - 1] if a else 0)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        x, h = _hashes(b"".join(strings[a:b]), k)
        h[(ends[:, None] - np.arange(1, k)).ravel()] = ~np.uint64(0)  # these would reach into the next string
        least = np.minimum.reduceat(h, starts)
        hit = np.flatnonzero(h == np.repeat(least, lengths))
        own = np.searchsorted(ends, hit, side="right")
        place = np.zeros(b - a, np.int64)
        place[own] = hit
        sides = []
        for begin in (place - half, place):
            inside = (begin >= starts) & (begin + k + half <= ends)
            key, begin = least.copy(), np.where(inside, begin, 0)
            for j in (*range(0, k + half - 8, 8), k + half - 8):
                key ^= x[begin + j]
                key *= _B
                key ^= key >> np.uint64(29)
            sides += [inside, key]
        found.append((least, np.bincount(own, minlength=b - a) > 1, *sides))
    least, twice, *sides = (np.concatenate(c) for c in zip(*found, strict=True))
    share = np.zeros(len(strings), bool)
    for inside, key in (sides[:2], sides[2:]):
        _, number, count = np.unique(key[inside], return_inverse=True, return_counts=True)
        share[inside] |= count[number] > 1
    _, number, count = np.unique(least, return_inverse=True, return_counts=True)
    many = np.zeros(len(count), bool)
    many[number[twice]] = True
    return share | (many & (count > 1))[number]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash: ranges of its upper half."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Block:
    """Documents that were written together, with the numbers of their rows and whether they have an id, and, once found, the runs of all of them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, named: np.ndarray, ends: np.ndarray, data: bytes, width: int):
        self.ids, self.rows, self.named, self.ends, self.data, self.width = ids, rows, named, ends, data, width

    def find_runs(self, k: int) -> Block:
        ends, data, width = self.ends, self.data, self.width
        found = []
        for at in range(0, len(data), SLICE):  # slices stay near the processor, however long a document is
            stop = min(len(data), at + SLICE + width - 1)
            i, j = (int(np.searchsorted(ends, x, side="right")) for x in (at, stop - 1))
            h, doc, place, n = runs(data[at:stop], ends[i : j + 1] - at, width, k)
            found.append((h, doc + i, place + at, n))
        join = lambda c, t: np.concatenate([f[c] for f in found] or [np.zeros(0)]).astype(t)
        self.hash, self.doc, self.place, self.windows = join(0, np.uint64), join(1, np.int32), join(2, np.int64), join(3, np.int64)
        return self

    def write_runs(self, path: str, cuts: np.ndarray, own: np.ndarray) -> None:
        """What is left to know of the runs once minimizers are numbered: ``cuts`` of the numbers by the shards' ranges, runs a document, windows, numbers."""
        fs, name = file_system(path)
        parts = cuts.astype("<i4"), np.bincount(self.doc, minlength=len(self.ids)).astype("<i4"), self.windows.astype("<u1"), own.astype("<i4")
        put(fs, name, _row(0, 0, "", 0, *parts)[4])

    def read_runs(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        """The runs again, but for their hashes; returns the cuts and the numbers of the minimizers."""
        fs, name = file_system(path)
        with fs.open_input_stream(name) as f:
            raw = f.read()
        cuts, count, windows, own = (np.frombuffer(p, t) for p, t in zip(_parts(raw), ("<i4", "<i4", "u1", "<i4"), strict=True))
        self.doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
        self.windows = windows.astype(np.int64)
        # Runs of a document follow each other without gaps, from its first byte.
        before = np.cumsum(self.windows) - self.windows
        first = np.cumsum(count, dtype=np.int64) - count
        starts = np.concatenate([[0], self.ends[:-1]])
        held = count > 0
        self.place = before + np.repeat(starts[held] - before[first[held]], count[held])
        return cuts, own

    def write(self, path: str) -> None:
        fs, name = file_system(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        body = pa.compress(self.data, "zstd", asbytes=True)
        put(fs, name, b"".join([np.array([len(self.ids), len(self.data)], "<i8").tobytes(), *[v.astype("<i8").tobytes() for v in (self.ids, self.rows, self.named, self.ends)], body]))

    @classmethod
    def read(cls, path: str, width: int) -> Block:
        fs, name = file_system(path)
        with fs.open_input_stream(name) as f:
            raw = f.read()
        n, size = np.frombuffer(raw, "<i8", 2).tolist()
        parts = [np.frombuffer(raw, "<i8", n, 16 + 8 * n * k) for k in range(4)]
        return cls(*parts, pa.decompress(memoryview(raw)[16 + 32 * n :], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", width)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimizers in order, whether two documents of the block have each, and each run's number among them."""
        order = np.argsort(self.hash)
        h, doc = self.hash[order], self.ids[self.doc[order]]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        number = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        many = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins) if len(h) else np.zeros(0, bool)
        own = np.empty(len(h), np.int64)
        own[order] = number
        return h[new], many, own

    def strings(self, wanted: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct strings of the wanted runs, the number of each run's string, and each string's first run."""
        data, extra = self.data, self.width - 1
        numbers: dict[bytes, int] = {}
        put_ = numbers.setdefault
        own = [put_(data[a : a + n], len(numbers)) for a, n in zip(self.place[wanted].tolist(), (self.windows[wanted] + extra).tolist(), strict=True)]
        own = np.array(own, np.int64)
        first = np.zeros(len(numbers), np.int64)
        first[own[::-1]] = np.arange(len(own))[::-1]
        return list(numbers), own, wanted[first]


def _row(shard: int, block: int, path: str, kind: int, *parts: np.ndarray | bytes) -> tuple:
    """Arrays as bytes, each after its length."""
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return shard, block, path, kind, b"".join(x for r in raw for x in (len(r).to_bytes(8, "little"), r))


def _parts(data: bytes) -> list[memoryview]:
    out, at, view = [], 0, memoryview(data)
    while at < len(view):
        n = int.from_bytes(view[at : at + 8], "little")
        out.append(view[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _emit(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), ROW_SCHEMA.types, strict=True)], ROW_SCHEMA.names)
    for row in rows:
        held.append(row)
        size += len(row[4])
        if size >= most:
            yield make()
            held, size = [], 0
    if held:
        yield make()


def _groups(batches, key: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows by key; the rows of a partition are sorted by it."""
    now, held = None, []
    for batch in sliced(batches, 64):
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def _blocks(batches, block_bytes: int) -> Iterator[tuple[list[int | None], list[int], list[bytes]]]:
    """Ids, row numbers and texts of blocks."""
    ids, rows, texts, size = [], [], [], 0
    for batch in sliced(batches, 256):
        numbers = batch.column(2).to_pylist() if batch.num_columns > 2 else [0] * batch.num_rows
        for i, t, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), numbers, strict=True):
            b = t.encode("utf-8", "surrogatepass")
            ids.append(i)
            rows.append(r)
            texts.append(b)
            size += len(b)
            if size >= block_bytes:
                yield ids, rows, texts
                ids, rows, texts, size = [], [], [], 0
    if ids:
        yield ids, rows, texts


def _together(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of consecutive ranges of at most ``most`` bytes, or of one range that is larger."""
    a, held = 0, 0
    for b, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield a, b
            a, held = b, 0
        held += size
    if held:
        yield a, len(sizes)


def removed_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, k: int = 16, block_bytes: int = 12 << 20, shards: int | None = None, kept: str = "bytes", row_col: str | None = None, sort_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, starts, ends, kept`` — spans of bytes to remove, in order, and what stays; and ``row``, the numbers in ``row_col``, if that is given.

    A byte goes if it lies in ``width`` bytes that also start in a document of
    smaller id; matches are judged on the input and never cross documents. A
    null text is empty; texts shorter than ``width`` stay whole. Rows that
    share an id are one document to each other: neither removes from the other.
    A NULL id counts as the largest there can be.
    Other columns play no part; an empty table gives no rows. Blocks rely on a
    partition giving its rows in the same order if a task runs again, as tables
    do. A shard's strings are sorted about ``sort_bytes`` at a time; only those
    of one range of minimizers are never parted. ``kept`` asks for the remaining ``bytes``, for them as ``text`` without
    the parts of characters that were cut through, or for their ``sha256``.
    """
    spark = df.sparkSession
    folder = fresh_path(spark, "blocks")
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A task holds one shard at a time, so small shards bound its memory.
    shards = shards or 4 * partitions

    def start(batches):
        def rows():
            part = TaskContext.get().partitionId()
            for number, (ids, numbers, texts) in enumerate(_blocks(batches, block_bytes)):
                own = np.array([NO_ID if i is None else i for i in ids], np.int64)
                block = Block(own, np.array(numbers, np.int64), np.array([i is not None for i in ids]), np.cumsum([len(t) for t in texts]), b"".join(texts), width).find_runs(k)
                key, path = (part << 24) + number, f"{folder}/{part:06d}-{number:06d}-{uuid.uuid4().hex}"
                block.write(path)
                h, many, numbered = block.distinct()
                ranges = np.searchsorted(shard_of(h, shards * RANGES), np.arange(shards * RANGES + 1))
                block.write_runs(f"{path}-found", ranges, numbered)
                cuts = ranges[::RANGES]
                for s in range(shards):
                    a, b = int(cuts[s]), int(cuts[s + 1])
                    # Each shard answers each block, if only to name it.
                    if b > a or not s:
                        yield _row(s, key, path, 0, h[a:b].astype("<u4"), np.packbits(many[a:b]))

        yield from _emit(rows())

    def share(batches):
        def rows():
            for s, got in _groups(batches, 0):
                parts = [_parts(r[4]) for r in got]
                values = [np.frombuffer(p[0], "<u4") for p in parts]
                many = [np.unpackbits(np.frombuffer(p[1], np.uint8), count=len(v)).astype(bool) for p, v in zip(parts, values, strict=True)]
                every = np.sort(np.concatenate([*[np.unique(v) for v in values], *[v[m] for v, m in zip(values, many, strict=True)]]))
                twice = np.unique(every[1:][every[1:] == every[:-1]])
                for r, v in zip(got, values, strict=True):
                    at = np.minimum(np.searchsorted(twice, v), max(0, len(twice) - 1))
                    known = twice[at] == v if len(twice) else np.zeros(len(v), bool)
                    yield _row(s, r[1], r[2], 1, np.packbits(known))

        yield from _emit(rows())

    def wanted_of(cuts: np.ndarray, own: np.ndarray, got: list[tuple]) -> np.ndarray:
        """Runs whose minimizer another document has."""
        known = np.zeros(int(cuts[-1]), bool)
        for r in got:
            if r[3] == 1:
                a, b = int(cuts[r[0]]), int(cuts[r[0] + 1])
                known[a:b] = np.unpackbits(np.frombuffer(_parts(r[4])[0], np.uint8), count=b - a).astype(bool)
        return np.flatnonzero(known[own])

    def send(batches):
        def rows():
            for key, got in _groups(batches, 1):
                block = Block.read(path := got[0][2], width)
                ranges, number = block.read_runs(f"{path}-found")
                wanted = wanted_of(ranges[::RANGES], number, got)
                strings, own, first = block.strings(wanted)
                least = np.full(len(strings), np.iinfo(np.int64).max)
                np.minimum.at(least, own, block.ids[block.doc[wanted]])
                part = np.searchsorted(ranges, number[first], side="right") - 1
                order = np.argsort(part, kind="stable")
                held = np.bincount(part, minlength=shards * RANGES).reshape(shards, RANGES)
                cuts = [0, *np.cumsum(held.sum(axis=1)).tolist()]
                # What the last step needs of each wanted run: document, first window, windows, string in shard order.
                rank = np.empty(len(strings), np.int64)
                rank[order] = np.arange(len(strings))
                fs, name = file_system(f"{path}-runs")
                put(fs, name, pa.compress(_row(0, 0, "", 0, block.doc[wanted].astype("<i4"), block.place[wanted].astype("<i4"), block.windows[wanted].astype("<u2"), rank[own].astype("<i4"))[4], "zstd", asbytes=True) if len(wanted) else b"")
                yield _row(-1, key, path, 2, b"")
                for s in range(shards):
                    mine = order[cuts[s] : cuts[s + 1]]
                    if len(mine):
                        chosen = [strings[i] for i in mine.tolist()]
                        yield _row(s, key, path, 3, held[s].astype("<u4"), np.array([len(x) for x in chosen], "<u2"), least[mine].astype("<i8"), b"".join(chosen))

        yield from _emit(rows())

    def sort(batches):
        def rows():
            for s, got in _groups(batches, 0):
                if s < 0:  # blocks that must be named in the last step
                    for r in got:
                        yield _row(-1, r[1], r[2], 4, b"")
                    continue
                rows_ = []
                for r in got:
                    held, lengths, low, data = _parts(r[4])
                    ends = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "<u2"), dtype=np.int64)])
                    rows_.append((np.concatenate([[0], np.cumsum(np.frombuffer(held, "<u4"), dtype=np.int64)]), ends, np.frombuffer(low, "<i8"), data))
                found = [([], [], []) for _ in got]
                for a, b in _together(sum(np.diff(ends[held]) for held, ends, _, _ in rows_), sort_bytes):
                    numbers: dict[bytes, int] = {}
                    own, least = [], []
                    for held, ends, low, data in rows_:
                        i, j = int(held[a]), int(held[b])
                        raw, at = bytes(data[ends[i] : ends[j]]), (ends[i : j + 1] - ends[i]).tolist()
                        own.append(np.array([numbers.setdefault(raw[x:y], len(numbers)) for x, y in zip(at[:-1], at[1:], strict=True)], np.int64))
                        least.append(low[i:j])
                    owner = np.full(len(numbers), np.iinfo(np.int64).max)
                    np.minimum.at(owner, np.concatenate(own), np.concatenate(least))
                    strings = list(numbers)
                    windows = np.array([len(x) for x in strings], np.int64) - (width - 1)
                    begins = np.cumsum(windows) - windows
                    value, shared = np.repeat(owner, windows), may_share(strings, width, k)
                    value[np.repeat(shared, windows)] = least_owner([x for x, y in zip(strings, shared.tolist(), strict=True) if y], owner[shared], width)[0]
                    numbers.clear()
                    del strings
                    # Stretches of windows with one value, within a string.
                    change = np.ones(len(value), bool)
                    change[1:] = value[1:] != value[:-1]
                    change[begins] = True
                    at = np.flatnonzero(change)
                    lengths, values = np.diff(at, append=len(value)), value[at]
                    first = np.searchsorted(at, begins)
                    count = np.diff(first, append=len(at))
                    for parts, mine in zip(found, own, strict=True):
                        take = np.repeat(first[mine] - (np.cumsum(count[mine]) - count[mine]), count[mine]) + np.arange(int(count[mine].sum()))
                        for p, v in zip(parts, (count[mine].astype("<u2"), lengths[take].astype("<u2"), values[take].astype("<i8")), strict=True):
                            p.append(v)
                for r, parts in zip(got, found, strict=True):
                    yield _row(s, r[1], r[2], 4, *[np.concatenate(p) for p in parts])

        yield from _emit(rows())

    form = {"bytes": lambda b: b, "text": lambda b: b.decode("utf-8", "ignore"), "sha256": lambda b: hashlib.sha256(b).hexdigest()}[kept]
    kept_type = "binary" if kept == "bytes" else "string"
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary() if kept == "bytes" else pa.string()), ("row", pa.int64())])

    def finish(batches):
        for _, got in _groups(batches, 1):
            path = got[0][2]
            block = Block.read(path, width)
            removed = np.zeros(len(block.data) + 1, np.int32)
            fs, name = file_system(f"{path}-runs")
            with fs.open_input_stream(name) as f:
                raw = f.read()
            got = sorted((r for r in got if r[0] >= 0), key=lambda r: r[0])
            if got and raw:
                doc, place, windows, string = (np.frombuffer(p, t) for p, t in zip(_parts(_decompressed(raw)), ("<i4", "<i4", "<u2", "<i4"), strict=True))
                parts = [_parts(r[4]) for r in got]
                count = np.concatenate([np.frombuffer(p[0], "<u2") for p in parts]).astype(np.int64)
                lengths = np.concatenate([np.frombuffer(p[1], "<u2") for p in parts]).astype(np.int64)
                values = np.concatenate([np.frombuffer(p[2], "<i8") for p in parts])
                first = np.cumsum(count) - count
                offset = np.cumsum(lengths) - lengths
                n = count[string]
                take = np.repeat(first[string] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                begin = np.repeat(place.astype(np.int64) - offset[first[string]], n) + offset[take]
                gone = values[take] < np.repeat(block.ids[doc], n)
                np.add.at(removed, begin[gone], 1)
                np.add.at(removed, begin[gone] + lengths[take][gone] + width - 1, -1)
                del doc, place, windows, string, parts, count, lengths, values, first, offset, take, begin, gone, n
            del got, raw
            mask = np.cumsum(removed[:-1], out=removed[:-1]) > 0
            edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            del removed, mask
            all_starts, all_ends = edges[::2], edges[1::2]
            rows, size = [], 0
            for i, (a, b) in enumerate(zip([0, *block.ends[:-1].tolist()], block.ends.tolist(), strict=True)):
                # Spans of neighbours in the block may touch; each is cut at its document's ends.
                lo, hi = np.searchsorted(all_ends, a, side="right"), np.searchsorted(all_starts, b, side="left")
                s, e = np.maximum(all_starts[lo:hi], a), np.minimum(all_ends[lo:hi], b)
                cuts = [a, *np.stack([s, e], axis=1).ravel().tolist(), b]
                stays = form(b"".join([block.data[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)]))
                rows.append((int(block.ids[i]) if block.named[i] else None, b - a, (s - a).tolist(), (e - a).tolist(), stays, int(block.rows[i])))
                size += len(stays)
                if size >= 4 << 20 or i == len(block.ends) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out_schema.types, strict=True)], out_schema.names)
                    rows, size = [], 0

    by_shard = lambda d: d.repartitionById(partitions, F.pmod(F.col("shard") + 1, F.lit(partitions))).sortWithinPartitions("shard", "block")
    by_block = lambda d: d.repartition(partitions, "block").sortWithinPartitions("block", "shard")
    sent = by_block(by_shard(keyed_text(df, id_col, text_col, row_col).mapInArrow(lean(start), ROW)).mapInArrow(lean(share), ROW)).mapInArrow(lean(send), ROW)
    out = by_block(by_shard(sent).mapInArrow(lean(sort), ROW)).mapInArrow(lean(finish), f"doc_id long, n_bytes long, starts array<long>, ends array<long>, kept {kept_type}, row long")
    return out if row_col else out.drop("row")


def _decompressed(raw: bytes) -> bytes:
    with pa.CompressedInputStream(pa.BufferReader(raw), "zstd") as f:
        return f.read()
