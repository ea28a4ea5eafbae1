"""Files of wells: one CSV per well and kind, the well's key in the file name.

Schemas are declared for training and test files; nothing is inferred.
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoframe.functions.scalar import hidden, nan_to_null, row_key
from lithoframe.sources.scratch import write_text

# Column names of the input files: fixed values.
TOPS = ["ANCC", "ASTNU", "ASTNL", "EGFDU", "EGFDL", "BUDA"]
HORIZONTAL = {"train": ["MD", "X", "Y", "Z", *TOPS, "TVT", "GR", "TVT_input"], "test": ["MD", "X", "Y", "Z", "GR", "TVT_input"]}
TYPEWELL = {"train": ["TVT", "GR", "Geology"], "test": ["TVT", "GR"]}
SUFFIX = {"horizontal": "__horizontal_well.csv", "typewell": "__typewell.csv"}


def schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType() if n == "Geology" else T.DoubleType()) for n in names])


def _scan(spark: SparkSession, folder: str, kind: str, names: list[str], skip_bad: bool) -> DataFrame:
    reader = spark.read.schema(schema(names)).option("header", True).option("pathGlobFilter", f"*{SUFFIX[kind]}")
    rows = reader.option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST").option("nanValue", "nan").option("ignoreCorruptFiles", skip_bad).option("enforceSchema", skip_bad).csv(folder)
    if skip_bad:  # files whose first line is not the header that is expected are left out
        lines = spark.read.option("pathGlobFilter", f"*{SUFFIX[kind]}").option("ignoreCorruptFiles", True).text(folder)
        good = lines.filter(F.trim("value") == ",".join(names)).select(F.col("_metadata.file_path").alias("__path")).distinct()
        rows = rows.withColumn("__path", F.col("_metadata.file_path")).withColumn("__name", F.col("_metadata.file_name")).join(good, "__path", "left_semi")
        return nan_to_null(rows.select(F.split("__name", "__")[0].alias("well"), *names))
    return nan_to_null(rows.select(F.split(F.col("_metadata.file_name"), "__")[0].alias("well"), *names))


def list_wells(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted keys of the wells that have a horizontal log, from file names alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX['horizontal']}").load(folder)
    return files.select(F.split(F.element_at(F.split("path", "/"), -1), "__")[0].alias("well")).distinct().orderBy("well")


def read_horizontal(spark: SparkSession, folder: str, split: str = "train", columns: list[str] | None = None, skip_bad: bool = False) -> DataFrame:
    """Horizontal logs of all wells with ``well`` and a 0-based ``row_idx`` by depth.

    Depth rises strictly in a well, so it gives the order of the file. With
    ``columns`` only those are parsed, and ``row_idx`` is left out.
    """
    names = HORIZONTAL[split]
    rows = _scan(spark, folder, "horizontal", names, skip_bad)
    if columns:
        return rows.select("well", *columns)
    number = (F.row_number().over(Window.partitionBy("well").orderBy("MD")) - 1).cast("int")
    return rows.select("well", number.alias("row_idx"), *names)


def read_typewells(spark: SparkSession, folder: str, split: str = "train", skip_bad: bool = False) -> DataFrame:
    return _scan(spark, folder, "typewell", TYPEWELL[split], skip_bad)


def load_train_test(spark: SparkSession, root: str, skip_bad: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Horizontal logs and typewells of training, then of test."""
    return tuple(read(spark, f"{root}/{s}", s, skip_bad=skip_bad) for s in ("train", "test") for read in (read_horizontal, read_typewells))


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both splits with a ``split`` column; columns that a split lacks are NULL."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)


def duplicate_depths(df: DataFrame, key: str = "well", depth: str = "MD") -> DataFrame:
    """Wells whose depths tie, for which ``row_idx`` would depend on chance."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(depth).alias("depths")).filter("n > depths")


def submission_template(test: DataFrame) -> DataFrame:
    """``id`` and a zero ``tvt`` for each hidden row."""
    return test.filter(hidden()).select(row_key().alias("id"), F.lit(0.0).alias("tvt"))


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet with zstd, in the given column order: features, out-of-fold and test predictions, profiles."""
    (df.select(*columns) if columns else df).write.mode(mode).option("compression", "zstd").parquet(path)


def write_submission(predictions: DataFrame, path: str, value: str = "tvt_pred") -> None:
    """One CSV file with a header: hidden rows as ``id, tvt``, in order of the key."""
    rows = predictions.filter("is_hidden").orderBy("well", "row_idx").select(row_key().alias("id"), F.col(value).alias("tvt"))
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_summary(summary: DataFrame, path: str) -> dict[str, Any]:
    """Write a summary (one row per split) as one indented JSON file; returns it."""
    out = {r["split"]: json.loads(r["body"]) for r in summary.select("split", F.to_json(F.struct(*[c for c in summary.columns if c != "split"])).alias("body")).collect()}
    write_text(summary.sparkSession, path, json.dumps(out, indent=2))
    return out


def load_config(path: str) -> dict[str, Any]:
    """A JSON file, or a YAML file where a YAML reader is installed."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package; JSON works without") from e
    return yaml.safe_load(text)
