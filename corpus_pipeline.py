"""A corpus pipeline: toxicity filter, exact dedup, near-duplicate removal, substring dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept; all but the last return the columns of ``documents``. A stage's
result is written as Parquet in the shared folder and read again.

A stage tells rows apart by numbers of its own, never by ``doc_id``: rows that
repeat an id, and rows without one, are rows like others. A null text is empty
to every stage, and stays null where nothing is cut from it. Other columns pass
through, whatever their names; ``n_chars`` follows the text where it is there.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm.common import with_row, written
from lithoframe.llm.exact_dedup import exact_dedup
from lithoframe.llm.packing import pack_documents
from lithoframe.llm.queries import table, tokenizer
from lithoframe.llm.simhash import simhash_groups
from lithoframe.llm.suffix_dedup import removed_spans
from lithoframe.llm.toxicity import train_toxicity, with_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5."""
    net = train_toxicity(docs, table(spark, sf_dir, "labels"))
    score = "toxicity_score"
    while score in docs.columns:
        score += "_"
    return with_toxicity(docs, net, score_col=score).filter(F.col(score) < 0.5).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the largest id; one row of those that tie in it. An id ranks above none."""
    rows, row = with_row(docs)
    dropped = exact_dedup(rows, row_col=row).filter("not kept").select(F.col("row").alias(row))
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row of the smallest id; one row of those that tie in it. An id ranks before none."""
    rows, row = with_row(docs)
    groups = written(simhash_groups(rows, id_col=row).select(F.col("doc_id").alias("member"), F.col("component_id").alias("of")), "groups")
    others = groups.filter("member <> of")
    members = others.union(others.select(F.col("of").alias("member"), "of").distinct())
    # Sides are merged, or written plain: an estimate by compressed files would broadcast what fills the driver.
    ranked = members.hint("merge").join(rows.select(F.col(row).alias("member"), "doc_id"), "member")
    first = ranked.groupBy("of").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "member"))["member"].alias("member"))
    dropped = written(members.join(first.select("member").hint("merge"), "member", "left_anti").select(F.col("member").alias(row)), "dropped", "uncompressed")
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the passages that a row of smaller id has; rows that share an id take nothing from each other."""
    rows, row = with_row(docs)
    kept, none = f"{row}_kept", f"{row}_none"
    cut = removed_spans(rows, kept="text", row_col=row).select(F.col("row").alias(row), F.col("kept").alias(kept))
    # Merged, not broadcast: the estimate of what is cut is that of the marks it is made from, without the texts.
    found = rows.withColumn(none, F.col("text").isNull()).drop("text").join(cut.hint("merge"), row)
    new = {"text": F.when(~F.col(none), F.col(kept))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(none), F.col("n_chars")).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    return found.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer(), with_ids=False)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash", near), ("suffix_dedup", substrings), ("packing", packing)]

#: SQL expresses neither the classifier nor the tokenizer; a test compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
