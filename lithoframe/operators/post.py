"""Physics and post-processing of predictions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def residual(target: str = "TVT", last: str = "tvt_input_visible_last") -> Column:
    """Target relative to the last known value; add ``last`` back after predicting."""
    return F.col(target) - F.col(last)


def well_bias(df: DataFrame, formation: str, key: str = "well", decay: float | None = None, order: str = "row_idx", seen: str = "TVT_input") -> DataFrame:
    """``b_well``: mean of TVT + Z - formation over visible rows, weighted by exp(decay i) for the i-th if ``decay`` is given.

    Weights are relative to the last visible row, so that they never overflow.
    """
    v = df.filter(F.col(seen).isNotNull()).withColumn("__v", F.col(seen) + F.col("Z") - F.col(formation))
    if decay is None:
        return v.groupBy(key).agg(F.avg("__v").alias("b_well"))
    i = F.row_number().over(Window.partitionBy(key).orderBy(order))
    last = F.count("*").over(Window.partitionBy(key))
    weighted = v.withColumn("__w", F.exp(F.lit(decay) * (i - last)))
    return weighted.groupBy(key).agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("b_well"))


def closed_form(formation: str, bias: str = "b_well") -> Column:
    return -F.col("Z") + F.col(formation) + F.col(bias)


def z_velocity_path(df: DataFrame, key: str = "well", order: str = "row_idx", seen: str = "TVT_input") -> DataFrame:
    """``z_vel_delta`` of hidden rows: the running sum of (beta dZ/dMD + c) dMD, with beta and c fitted to visible steps."""
    w = Window.partitionBy(key).orderBy(order)
    step = {n: F.col(c) - F.lag(c).over(w) for n, c in (("__dz", "Z"), ("__dm", "MD"), ("__dt", seen))}
    d = df.withColumns(step)
    y = F.when(F.col(seen).isNotNull(), F.col("__dt") / F.col("__dm"))
    x = F.when(y.isNotNull(), F.col("__dz") / F.col("__dm"))
    fit = d.groupBy(key).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("__beta"), F.coalesce(F.regr_intercept(y, x), F.avg(y), F.lit(0.0)).alias("__c"))
    moved = F.when(F.col(seen).isNull(), (F.col("__beta") * F.col("__dz") / F.col("__dm") + F.col("__c")) * F.col("__dm"))
    return d.join(fit, key).withColumn("z_vel_delta", F.coalesce(F.sum(moved).over(w), F.lit(0.0))).filter(F.col(seen).isNull()).select(*df.columns, "z_vel_delta")


def fade_in(delta: str | Column, since: str = "md_since", alpha: float = 1.0, tau: float | None = None) -> Column:
    d = F.col(delta) if isinstance(delta, str) else delta
    return F.lit(alpha) * d * (F.lit(1.0) if tau is None else 1 - F.exp(-F.greatest(F.col(since), F.lit(0.0)) / F.lit(tau)))


def fade_in_grid(df: DataFrame, delta: str, error: str, since: str = "md_since", alphas: tuple[float, ...] = (0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0), taus: tuple[float | None, ...] = (None, 25.0, 50.0, 100.0, 200.0)) -> DataFrame:
    """RMSE of every (alpha, tau) in one pass; ``error`` is the residual to be explained. ``tau`` is NULL for none.

    Squared error is quadratic in alpha, so per tau three sums serve all alphas.
    """
    faded = {t: fade_in(delta, since, 1.0, t) for t in taus}
    one = df.agg(F.count("*").alias("n"), *[F.array(F.sum(F.col(error) ** 2), F.sum(F.col(error) * f), F.sum(f * f)).alias(f"t{i}") for i, f in enumerate(faded.values())])
    cells = [F.struct(F.lit(a).alias("alpha"), F.lit(t).cast("double").alias("tau"), F.sqrt((F.col(f"t{i}")[0] - 2 * a * F.col(f"t{i}")[1] + a * a * F.col(f"t{i}")[2]) / F.col("n")).alias("rmse")) for a in alphas for i, t in enumerate(taus)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def savgol_weights(width: int = 17, degree: int = 3) -> np.ndarray:
    """Row p: weights of a window's values for the fitted polynomial at its place p."""
    x = np.arange(width) - width // 2
    a = np.vander(x, degree + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def savgol(df: DataFrame, value: str, width: int = 17, degree: int = 3, key: str = "well", order: str = "row_idx", out: str = "smooth") -> DataFrame:
    """Polynomial smoothing per well, in window expressions; the ends follow the fit of the first or last window.

    A well shorter than the window uses the largest odd width; one too short
    for the degree stays as it is. Expects values without gaps.
    """
    w = Window.partitionBy(key).orderBy(order)
    half = width // 2
    n, i = F.count("*").over(Window.partitionBy(key)), F.row_number().over(w) - 1
    around = F.collect_list(value).over(w.rowsBetween(-width, width))
    d = df.withColumns({"__n": n, "__i": i, "__a": around})
    begin = F.greatest(F.col("__i") - width, F.lit(0))  # the row of the list's first value
    def weighted(size: int) -> Column:
        m = savgol_weights(size, degree)
        first = F.least(F.greatest(F.col("__i") - size // 2, F.lit(0)), F.col("__n") - size)
        rows = F.lit([[float(v) for v in r] for r in m])
        row = F.element_at(rows, (F.col("__i") - first + 1).cast("int"))
        part = F.slice("__a", (first - begin + 1).cast("int"), F.lit(size))
        return F.aggregate(F.zip_with(part, row, lambda p, q: p * q), F.lit(0.0), lambda a, b: a + b)
    made = F.when(F.col("__n") >= width, weighted(width))
    for size in range(width - 2, degree + 1, -2):
        made = made.when(F.col("__n") >= size, weighted(size))
    del half
    return d.withColumn(out, made.otherwise(F.col(value))).select(*df.columns, out)


def snap_to(value: str, boundary: str, distance: str, reach: float = 10.0) -> Column:
    return F.when(F.col(distance) <= reach, F.col(boundary)).otherwise(F.col(value))


def clip_to_range(value: str, low: str, high: str, margin: float = 100.0) -> Column:
    return F.greatest(F.least(F.col(value), F.col(high) + margin), F.col(low) - margin)


def trust_blend(n_seen: str, path: str, own: str) -> Column:
    """A path and a self-match blended by how much is visible: the latter's share is n/200, at most 0.6."""
    t = F.least(F.greatest(F.col(n_seen) / 200.0, F.lit(0.0)), F.lit(0.6))
    return (1 - t) * F.col(path) + t * F.col(own)
