"""Token-ID files: every id in the fewest bits that the vocabulary needs.

A file holds consecutive documents, and is little-endian but for the packed bits:

    magic "LFTK", version u16, width u16, block ids u32, documents u64, ids u64
    document ids      i64 x documents
    document starts   u64 x (documents + 1), in ids from the file's first
    block offsets     u64 x (blocks + 1), in bytes from the payload's start
    payload           blocks of ``block ids`` ids, ``width`` bits each, highest bit first

A block starts at a byte, so any id is read without those before it.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.llm.common import fresh_path, keyed_text, lean, sliced, written
from lithoframe.llm.encoder import CHARS, ROWS, encode_each, encoder, in_groups

NO_ID = -(1 << 63)
MAGIC, VERSION, HEAD = b"LFTK", 1, struct.Struct("<4sHHIQQ")


def bit_width(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, highest bit first; the last byte is filled with zeros."""
    if ids.size and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack_bits(data, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return bits @ (np.uint32(1) << np.arange(width - 1, -1, -1, dtype=np.uint32))


def token_bytes(doc_ids, lengths, ids: np.ndarray, width: int, block: int = 4096) -> bytes:
    """A file's content for documents of these lengths, whose ids follow each other in ``ids``."""
    starts = np.zeros(len(lengths) + 1, "<u8")
    np.cumsum(lengths, out=starts[1:])
    blocks = [pack_bits(ids[i : i + block], width) for i in range(0, len(ids), block)]
    offsets = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(b) for b in blocks], out=offsets[1:])
    head = HEAD.pack(MAGIC, VERSION, width, block, len(lengths), len(ids))
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Random access to a file's documents and ids."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, version, self.width, self.block, self.n_docs, self.n_ids = HEAD.unpack_from(self.data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at = HEAD.size
        self.doc_ids = np.frombuffer(self.data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(self.data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.payload = at + 8 * (n_blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop``; only their blocks are unpacked."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        out = [unpack_bits(self.data[self.payload + self.offsets[b] : self.payload + self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.width) for b in range(first, last + 1)]
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def put(fs: pa.fs.FileSystem, path: str, data: bytes) -> None:
    """Write under another name, then rename: a task that is run again leaves one whole file."""
    other = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(other) as f:
        f.write(data)
    fs.move(other, path)


def write_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_ids: int = 8_000_000, block: int = 4096) -> DataFrame:
    """Encode all texts and write them in ascending id order; returns the manifest (``path``, ``part``, ``number``, ``n_docs``, ``n_tokens``).

    Null texts are empty and give ``end_id`` alone. Rows that repeat an id are
    each written; those without an id come first, under ``NO_ID``. Other columns play no part; an empty table gives no files.
    A file holds about ``file_ids`` ids, which bounds a task's memory whatever
    its partition holds.
    """
    spark = df.sparkSession
    out = fresh_path(spark, "tokens")

    def write(batches):
        coder = encoder(tokenizer_path)
        width = bit_width(max(coder.vocab_size, end_id + 1))
        fs, base = file_system(out)
        fs.create_dir(base, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(4, "little")
        docs, lengths, ids, held = [], [], [], 0

        def flush():
            path = f"part-{part:06d}-{number:06d}.tok"
            put(fs, f"{base}/{path}", token_bytes(docs, lengths, np.frombuffer(b"".join(ids), "<u4"), width, block))
            return pa.RecordBatch.from_pydict({"path": [f"{out}/{path}"], "part": [part], "number": [number], "n_docs": [len(docs)], "n_tokens": [held]})

        for batch in sliced(batches, ROWS):
            for keys, texts in in_groups(batch.column(0).to_pylist(), batch.column(1).to_pylist(), CHARS):
                for key, got in zip(keys, encode_each(coder.encode, texts, coder.marked), strict=True):
                    docs.append(NO_ID if key is None else key)
                    ids += (got, end)
                    lengths.append(len(got) // 4 + 1)
                    held += lengths[-1]
                if held >= file_ids:
                    yield flush()
                    docs, lengths, ids, held, number = [], [], [], 0, number + 1
        if docs:
            yield flush()

    ordered = keyed_text(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(lean(write), "path string, part long, number long, n_docs long, n_tokens long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read a manifest's files: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``.

    A file's first id follows from the sums of the parts before its own and of
    the files before it in its part; one task sees a row for each part.
    """
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("earlier"))
    inner = manifest.select("part", "path", before(Window.partitionBy("part").orderBy("number")).alias("inner"))
    files = inner.join(parts, "part").select("path", (F.col("earlier") + F.col("inner")).alias("base"))
    # A task reads one file, or a few where there are very many.
    files = files.repartition(max(1, min(manifest.count(), 20_000)), "path")

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = file_system(path)
                with fs.open_input_stream(name) as f:
                    tokens = TokenFile(f.read())
                for lo in range(0, tokens.n_docs, 2000):
                    hi = min(tokens.n_docs, lo + 2000)
                    first = tokens.starts[lo]
                    ids = tokens.ids(int(first), int(tokens.starts[hi])).astype("<u4")
                    cuts = tokens.starts[lo : hi + 1] - first
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(tokens.doc_ids[lo:hi], mask=tokens.doc_ids[lo:hi] == NO_ID), "start": tokens.starts[lo:hi] + base, "n_tokens": np.diff(cuts), "ids_crc32": np.array(crc, np.int64)})

    return files.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
