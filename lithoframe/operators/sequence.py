"""Ordered features of a sequence: rolling statistics, differences, anchors.

All functions take the key and order columns, so they run on any table. Frames
over rows need only a segment of a sequence and the rows before it:
``segmented`` deals one long sequence to many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.scalar import inclination, lateral, visible

ROLL_WINDOWS, DIFF_LAGS = (10, 50, 200), (1, 5, 20)


def by(key: str | list[str] = "well", order: str = "row_idx"):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def roll_mean(value: str, width: int, w) -> Column:
    """Mean of the last ``width`` values that are there; NULL if none is."""
    return F.avg(value).over(w.rowsBetween(1 - width, 0))


def roll_std(value: str, width: int, w) -> Column:
    """Sample deviation of the last ``width``; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(value).over(w.rowsBetween(1 - width, 0)), F.lit(0.0))


def rolling(value: str, w, widths: Iterable[int] = ROLL_WINDOWS) -> dict[str, Column]:
    return {f"{value}_roll_mean_{k}": roll_mean(value, k, w) for k in widths} | {f"{value}_roll_std_{k}": roll_std(value, k, w) for k in widths}


def centred(value: str, w, widths: Iterable[int] = (5, 21, 51, 101)) -> dict[str, Column]:
    return {f"{value}_centred_{k}": F.avg(value).over(w.rowsBetween(-(k // 2), k // 2)) for k in widths}


def shifts(value: str, w, steps: Iterable[int] = (1, 5, 15, 30)) -> dict[str, Column]:
    return {f"{value}_lag_{k}": F.lag(value, k).over(w) for k in steps} | {f"{value}_lead_{k}": F.lead(value, k).over(w) for k in steps}


def diffs(value: str, w, lags: Iterable[int] = DIFF_LAGS) -> dict[str, Column]:
    return {f"{value}_diff_{k}": F.col(value) - F.lag(value, k).over(w) for k in lags}


def derivatives(w) -> dict[str, Column]:
    """First differences of the path, the second of Z (its first two rows NULL), step length and inclination."""
    step = {f"d{c}": F.col(c) - F.lag(c, 1).over(w) for c in "XYZ"}
    second = F.col("Z") - 2 * F.lag("Z", 1).over(w) + F.lag("Z", 2).over(w)
    side = lateral(step["dX"], step["dY"])
    return step | {"d2Z": second, "lateral_velocity": side, "inclination": inclination(step["dZ"], side)}


def dogleg(w) -> dict[str, Column]:
    """Angle between the last two steps of the path; NULL without two steps of some length."""
    a = {c: F.col(c) - F.lag(c, 1).over(w) for c in "XYZ"}
    b = {c: F.lag(c, 1).over(w) - F.lag(c, 2).over(w) for c in "XYZ"}
    dot = a["X"] * b["X"] + a["Y"] * b["Y"] + a["Z"] * b["Z"]
    size = F.sqrt(a["X"] ** 2 + a["Y"] ** 2 + a["Z"] ** 2) * F.sqrt(b["X"] ** 2 + b["Y"] ** 2 + b["Z"] ** 2)
    return {"dogleg": F.when(size > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / size))))}


def cumulative(w) -> dict[str, Column]:
    """Running sum of GR, and the size of the steps of Z; ``cumulative_product`` has their running product."""
    now = w.rowsBetween(Window.unboundedPreceding, 0)
    return {"GR_cumsum": F.sum("GR").over(now), "dZ_abs": F.abs(F.col("Z") - F.lag("Z", 1).over(w))}


def cumulative_product(df: DataFrame, w, value: str = "Z") -> DataFrame:
    """``df`` with the running product of the steps of ``value``, as ``d<value>_prod_sign`` (0 from a step of 0 on) and ``d<value>_prod_log``, the logarithm of its size, which cannot overflow. Both NULL before the first step."""
    step = F.col("__step")
    now = w.rowsBetween(Window.unboundedPreceding, 0)
    held = df.withColumn("__step", F.col(value) - F.lag(value, 1).over(w))
    turned, zeros = F.sum((step < 0).cast("int")).over(now), F.sum((step == 0).cast("int")).over(now)
    sign = F.when(zeros > 0, 0).otherwise(1 - 2 * (turned % 2))
    size = F.sum(F.when(step != 0, F.log(F.abs(step)))).over(now)
    return held.withColumns({f"d{value}_prod_sign": sign.cast("int"), f"d{value}_prod_log": size}).drop("__step")


def anchor_aggregates(order: str = "row_idx", seen: str = "TVT_input") -> list[Column]:
    """Per sequence: the record at the largest visible row, wherever it is, and counts."""
    record = F.max_by(F.struct("MD", "X", "Y", "Z", F.col(seen).alias("TVT")), F.when(visible(seen), F.col(order)))
    return [F.when(F.count(seen) > 0, record).alias("anchor"), F.count("*").alias("n"), F.count(seen).alias("n_seen")]


def zscore_aggregates(value: str = "GR") -> list[Column]:
    """Population mean and deviation; the deviation never is 0."""
    return [F.avg(value).alias("gr_mean"), (F.stddev_pop(value) + 1e-9).alias("gr_std")]


def segmented(df: DataFrame, columns: Callable[[object], dict[str, Column]], reach: int, key: str = "well", order: str = "row_idx", rows: int = 100_000) -> DataFrame:
    """Window columns that look back at most ``reach`` rows, over segments of ``rows`` rows.

    ``order`` numbers a sequence's rows from 0 without gaps. A segment's task
    also gets the ``reach`` rows before it, so results equal those over whole
    sequences while one long sequence is spread over tasks.
    """
    if reach >= rows:
        raise ValueError("a segment must be longer than its reach")
    segment = F.floor(F.col(order) / rows)
    own = F.when((F.col(order) % rows) >= rows - reach, F.array(segment, segment + 1)).otherwise(F.array(segment))
    spread = df.withColumn("__segment", F.explode(own))
    w = by([key, "__segment"], order)
    made = spread.select(*df.columns, "__segment", *[c.alias(n) for n, c in columns(w).items()])
    return made.filter(F.col("__segment") == segment).drop("__segment")
