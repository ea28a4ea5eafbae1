"""Shared helpers: the cluster's shared folder, lineage cuts and stable column selection."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and runs on one
    machine, as in tests; on a cluster that is an error, as executors would
    write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty() and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lithoframe-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``fresh_path`` through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def keyed_text(df: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``; a null text is empty. Other columns, whatever their names, are left out, but for ``row_col``, which becomes ``row``."""
    row = [df[row_col].cast("long").alias("row")] if row_col else []
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), *row)


def with_row(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a number of its own for each row, whatever its columns hold, and that column's name.

    A row's number is its file's place among the table's files and its place in
    the file, so it is the same whenever the table is read. What isn't read
    from Parquet files is written first. The driver gets one path per file.
    """
    name = "row"
    while name in df.columns:
        name = f"{name}_"
    try:
        place = df.metadataColumn("_metadata")
        df.select(place["file_path"], place["row_index"])
    except AnalysisException:
        df = written(df, "rows")
        place = df.metadataColumn("_metadata")
    paths = sorted(r[0] for r in df.select(place["file_path"]).distinct().collect())
    files = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(paths)], f"{name}_path string, {name}_file long")
    placed = df.select("*", place["file_path"].alias(f"{name}_path"), place["row_index"].alias(f"{name}_at"))
    number = F.shiftleft(f"{name}_file", 40).bitwiseOR(F.col(f"{name}_at")).alias(name)
    return placed.join(F.broadcast(files), f"{name}_path").select(*df.columns, number), name


def salt_of(column: str | Column, salts: int) -> Column:
    """A salt in [0, salts) that spreads the rows of one hot key."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def crowded(counts: DataFrame, key: str, count: str, most: int) -> list:
    """Keys that more than ``most`` rows have, by a table of counts; the driver gets the total over ``most`` of them, if that many."""
    return [r[0] for r in counts.filter((F.col(count) > most) & F.col(key).isNotNull()).select(key).collect()]


def salted(df: DataFrame, key: str, hot: list, salts: int) -> DataFrame:
    """``df`` with ``salt``: a row for each salt where the key is one of ``hot``, else one row with salt 0."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col(key).isin(hot), salts - 1).otherwise(0))))


def sliced(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most ``rows`` rows, so that what a step makes of one stays small whatever the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that gives its memory back to the system when a task ends.

    Python workers outlive tasks, and several of them share an executor.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task
