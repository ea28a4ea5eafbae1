"""Group statistics, detrending, masks and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.scalar import correlation


def group_stats(df: DataFrame, value: str, key: str = "well") -> DataFrame:
    """Moments and distinct count per group; skewness and excess kurtosis of the population."""
    return df.groupBy(key).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.median(value).alias("median"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"), F.count_distinct(value).alias("nunique")
    )


def relative_to_group(value: str, mean: str = "mean") -> dict[str, Column]:
    return {f"{value}_diff_mean": F.col(value) - F.col(mean), f"{value}_ratio_mean": F.when(F.col(mean) != 0, F.col(value) / F.col(mean))}


def detrend(df: DataFrame, value: str = "GR", depth: str = "MD", key: str = "well", least: int = 5, out: str = "detrended") -> DataFrame:
    """``value`` less its least-squares slope times depth; unchanged with fewer than ``least`` points."""
    slope = df.groupBy(key).agg(F.when(F.count(F.when(F.col(depth).isNotNull(), F.col(value))) >= least, F.regr_slope(value, depth)).alias("__slope"))
    return df.join(slope, key).withColumn(out, F.col(value) - F.coalesce("__slope", F.lit(0.0)) * F.col(depth)).drop("__slope")


def interactions(eps: float = 1e-6) -> dict[str, Column]:
    c = F.col
    return {"GR_x_MD": c("GR") * c("MD"), "X_sq": c("X") ** 2, "GR_per_MD": c("GR") / (c("MD") + eps), "X_x_Y": c("X") * c("Y")}


def prefix_stats(df: DataFrame, key: str = "well") -> DataFrame:
    """Of the visible rows: length, slope of target over depth, and RMSE around that line."""
    y, x = F.col("TVT_input"), F.when(F.col("TVT_input").isNotNull(), F.col("MD"))
    r2 = F.coalesce(correlation(y, x), F.lit(0.0))
    return df.groupBy(key).agg(F.count(y).alias("prefix_length"), F.regr_slope(y, x).alias("prefix_slope"), (F.stddev_pop(y) * F.sqrt(F.greatest(F.lit(0.0), 1 - r2 * r2))).alias("prefix_rmse"))


def positions(anchor: str = "anchor", n: str = "n", n_seen: str = "n_seen") -> dict[str, Column]:
    """Of a row, against the last visible record: depth since, fraction of the hidden zone, and shifts."""
    c = F.col
    return {"md_since": c("MD") - c(f"{anchor}.MD"), "frac": (c("row_idx") - c(n_seen) + 1) / F.greatest(c(n) - c(n_seen), F.lit(1)), "dx": c("X") - c(f"{anchor}.X"), "dy": c("Y") - c(f"{anchor}.Y"), "dz": c("Z") - c(f"{anchor}.Z")}


def tail_mask(df: DataFrame, ratio: float | Column, key: str = "well", order: str = "row_idx", value: str = "TVT", out: str = "TVT_masked") -> DataFrame:
    """Hide the last ``ratio`` of each well: ``value`` where the row is before floor(n (1 - ratio)), else NULL."""
    n = df.groupBy(key).agg(F.count("*").alias("__n"))
    keep = F.col(order) < F.floor(F.col("__n") * (1 - (ratio if isinstance(ratio, Column) else F.lit(ratio))))
    return df.join(n, key).withColumn(out, F.when(keep, F.col(value))).drop("__n")


def random_ratio(key: str = "well", seed: int = 42, low: float = 0.4, high: float = 0.85) -> Column:
    """A mask ratio per well between ``low`` and ``high``, set by a hash of its key."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("double")
    return F.lit(low) + F.lit(high - low) * drawn / 4294967296.0


def finite_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows where each column is there: ``feature, rate``."""
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("rate")) for c in columns])).alias("f")).select("f.*")


def gated(df: DataFrame, columns: list[str], least: float = 0.01) -> list[str]:
    """Columns that are there in at least ``least`` of the rows."""
    return [r.feature for r in finite_rates(df, columns).collect() if r.rate >= least]


def hidden_quantiles(df: DataFrame, value: str = "GR", key: str = "well", points: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    return df.filter(F.col("TVT_input").isNull()).groupBy(key).agg(*[F.percentile(value, F.lit(p)).alias(f"{value}_q{round(100 * p):02d}") for p in points])


def lag_order(key: str = "well", order: str = "row_idx"):
    return Window.partitionBy(key).orderBy(order)
