"""A bounded sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_fold: int, max_rows: int, max_chars: int) -> list[tuple[str, int]]:
    """Texts and labels of at most ``max_rows`` rows outside the held-out fold, in an order set by a hash of the id.

    Rows without a label are left out, as are training texts of more than
    ``max_chars`` characters; both limits are on fitting only, and bound what
    the driver holds to their product. Copies of a text count once.
    """
    rows = labels.filter(labels[label].isNotNull() & (fold_of("doc_id", folds) != held_fold))
    order = F.xxhash64("doc_id", F.lit(label))
    chosen = rows.select("doc_id", F.col(label).cast("int").alias("label")).orderBy(order, "doc_id").limit(max_rows)
    texts = documents.select(documents["doc_id"], F.coalesce(documents["text"], F.lit("")).alias("text")).filter(F.length("text") <= max_chars)
    found = texts.join(F.broadcast(chosen), "doc_id").select("text", "label").collect()
    return sorted({(r.text, r.label) for r in found})
