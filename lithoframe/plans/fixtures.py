"""Well-shaped views of the star-schema tables, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoframe.sources import scratch, wells

TOPS = [f"top{i}" for i in range(1, 7)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _wells(e: DataFrame, well) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    r = e.select(well.alias("well"), "event_id", "user_id", F.col("value").cast("double").alias("value"), k.alias("X"))
    i = (F.row_number().over(Window.partitionBy("well").orderBy("event_id")) - 1).cast("int")
    r = r.withColumns({"row_idx": i, "n": F.count("*").over(Window.partitionBy("well"))})
    r = r.withColumns({"MD": F.col("row_idx").cast("double"), "Y": (F.col("event_id") % 97).cast("double"), "Z": -F.col("value"), "GR": F.when(F.col("event_id") % 20 != 0, F.col("value"))})
    r = r.withColumn("TVT", 11000 + 2 * F.col("X") - F.col("Y") + 0.5 * F.col("Z") + 0.1 * (F.col("event_id") % 13))
    return r.withColumn("TVT_input", F.when(F.col("row_idx") < F.floor(0.26 * F.col("n")), F.col("TVT"))).select("well", "row_idx", "MD", "X", "Y", "Z", "GR", "TVT", "TVT_input", "user_id")


def well_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few long wells, one per event type."""
    return _wells(table(spark, sf_dir, "events"), F.col("event_type")).drop("user_id")


def well_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short wells, one per user; every fifth is a test well, without target."""
    w = _wells(table(spark, sf_dir, "events"), F.col("user_id").cast("string"))
    test = F.col("user_id") % 5 == 0
    return w.withColumns({"split": F.when(test, "test").otherwise("train"), "TVT": F.when(~test, F.col("TVT"))}).drop("user_id")


def typewell(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select((10000 + 0.5 * F.col("p_partkey")).alias("TVT"), F.col("p_retailprice").cast("double").alias("GR"), F.col("p_brand").alias("Geology"))


def user_typewells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short typewell for each user well: depths from 10600 in steps of 7.5, one row for each of its first rows."""
    w = well_user(spark, sf_dir).filter("row_idx < 40")
    return w.select("split", "well", (10600 + 7.5 * F.col("row_idx") + (F.col("X") * 0)).alias("TVT"), F.coalesce("GR", F.lit(1.0)).alias("GR"), F.when(F.col("row_idx") % 7 != 3, F.concat(F.lit("g"), F.floor(F.col("row_idx") / 9).cast("string"))).alias("Geology"))


def well_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of well files written from the user wells: ``train`` and ``test``, two CSV files a well, and in ``train`` two files that are none.

    Spark names the files it writes itself, so each is renamed: two names for
    each well pass through the driver.
    """
    root = scratch.fresh(spark, "wells")
    rows = well_user(spark, sf_dir).withColumns({t: F.col("TVT") + 10 * (i + 1) for i, t in enumerate(wells.TOPS)})
    fs, _ = scratch.file_system(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for kind, table_, order, columns in (("horizontal", rows, "MD", wells.HORIZONTAL), ("typewell", user_typewells(spark, sf_dir), "TVT", wells.TYPEWELL)):
        for split in ("train", "test"):
            fs.mkdirs(path(f"{root}/{split}"))
            own = table_.filter(F.col("split") == split).select("well", *columns[split])
            own.repartition("well").sortWithinPartitions("well", order).write.partitionBy("well").option("header", True).csv(f"{root}/{split}-{kind}")
            for found in fs.globStatus(path(f"{root}/{split}-{kind}/well=*/part-*")) or []:
                well = found.getPath().getParent().getName().split("=", 1)[1]
                fs.rename(found.getPath(), path(f"{root}/{split}/{well}{wells.SUFFIX[kind]}"))
    short = ",".join(wells.HORIZONTAL["train"][:-1])
    scratch.write_text(spark, f"{root}/train/short{wells.SUFFIX['horizontal']}", f"{short}\n{','.join('1.0' for _ in short.split(','))}\n")
    scratch.write_text(spark, f"{root}/train/junk{wells.SUFFIX['horizontal']}", "\u0000\u0001 not a table\n")
    return root


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("wid"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(["x", "y", *TOPS])])


def point_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(F.col("wid").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("wid").alias("self"))


def _well_sql(name: str, well: str) -> str:
    return f"""{name}_0 AS (SELECT {well} AS well, event_id, user_id, CAST(value AS DOUBLE) AS value, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS X,
        CAST(row_number() OVER (PARTITION BY {well} ORDER BY event_id) - 1 AS INTEGER) AS row_idx, count(*) OVER (PARTITION BY {well}) AS n FROM events),
    {name}_1 AS (SELECT well, row_idx, n, user_id, CAST(row_idx AS DOUBLE) AS MD, X, CAST(event_id % 97 AS DOUBLE) AS Y, -value AS Z, CASE WHEN event_id % 20 <> 0 THEN value END AS GR,
        11000 + 2 * X - CAST(event_id % 97 AS DOUBLE) + 0.5 * (-value) + CAST(0.1 AS DOUBLE) * (event_id % 13) AS TVT FROM {name}_0),"""


EV = _well_sql("ev", "event_type") + """
    ev AS (SELECT well, row_idx, MD, X, Y, Z, GR, TVT, CASE WHEN row_idx < floor(CAST(0.26 AS DOUBLE) * n) THEN TVT END AS TVT_input FROM ev_1)"""
USER = _well_sql("us", "CAST(user_id AS VARCHAR)") + """
    us AS (SELECT well, row_idx, MD, X, Y, Z, GR, CASE WHEN user_id % 5 <> 0 THEN TVT END AS TVT, CASE WHEN row_idx < floor(CAST(0.26 AS DOUBLE) * n) THEN TVT END AS TVT_input,
        CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM us_1)"""
TW = "tw AS (SELECT 10000 + CAST(0.5 AS DOUBLE) * p_partkey AS TVT, CAST(p_retailprice AS DOUBLE) AS GR, p_brand AS Geology FROM part)"
USER_TW = """ut AS (SELECT split, well, 10600 + CAST(7.5 AS DOUBLE) * row_idx AS TVT, coalesce(GR, 1.0::DOUBLE) AS GR, CASE WHEN row_idx % 7 <> 3 THEN 'g' || (row_idx // 9) END AS Geology FROM us WHERE row_idx < 40)"""
POINTS = "pts AS (SELECT vec_id AS wid, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(["x", "y", *TOPS])) + " FROM embeddings)"
