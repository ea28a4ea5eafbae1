"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import crowded, salt_of, salted, written

#: Pairs of a node from which it is spread; at least a thousandth of all, so the driver gets two thousand nodes at most.
HOT = 4096


def _with_least(pairs: DataFrame, salts: int, most: int) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the least of u and its v; a node with over ``most`` pairs is spread over salts."""
    hot = crowded(pairs.groupBy("u").count(), "u", "count", most)
    least = salted(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "u", hot, salts)
    # Merged, not broadcast: Spark's estimate of a side knows neither its compression nor its salts.
    return pairs.withColumn("salt", F.when(F.col("u").isin(hot), salt_of("v", salts)).otherwise(0)).join(least.hint("merge"), ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame, salts: int, most: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, salts, most).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, salts: int, most: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down, salts, most)
    stars = found.select(F.col("v").alias("u"), F.col("m").alias("v")).union(found.select("u", F.col("m").alias("v")))
    return stars.filter("u <> v")


def components(edges: DataFrame, a: str, b: str, salts: int = 16) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for each node of an undirected edge list.

    Every round is written to the shared folder, so lineage stays short and a
    lost executor costs one round at most. Rounds grow with the logarithm of
    the longest path. Loops and repeated edges do no harm.
    """
    now = written(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == state or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = seen
        most = max(HOT, seen[0] // 1000)
        now = written(_small_star(written(_large_star(now, salts, most).distinct(), "edges"), salts, most).distinct(), "edges")
