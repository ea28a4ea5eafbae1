"""Nearest centroids, plane imputation around a query point, and inverse-distance weighting.

Neighbours come from a grid join: a query meets the centroids of its cell and
the eight around it, and its neighbours are final when the farthest lies within
one cell's width. Queries for which they are not go on with cells twice as
wide. No step joins every query with every centroid, and nothing is broadcast
whose size is not checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.scalar import solve3
from lithoframe.sources.scratch import stored


def centroids(rows: DataFrame, tops: list[str], key: str = "well") -> DataFrame:
    """Medians of X, Y and tops per well, over rows where all are there; wells without such rows are left out."""
    names = ["X", "Y", *tops]
    return rows.na.drop(subset=names).groupBy(key).agg(*[F.median(c).alias(c) for c in names])


def scales(points: DataFrame, x: str = "x", y: str = "y") -> tuple[float, float]:
    """Population deviation of each axis; 1 where it is under 0.001. Two numbers reach the driver."""
    r = points.agg(F.stddev_pop(x), F.stddev_pop(y)).first()
    return tuple(1.0 if v is None or v < 1e-3 else float(v) for v in r)


def nearest(queries: DataFrame, points: DataFrame, k: int, scale: tuple[float, float], max_rounds: int = 64) -> DataFrame:
    """The ``k`` nearest points in scaled distance: ``qid, wid, dist, rank`` and the points' columns.

    ``queries``: ``qid, qx, qy, self`` (a point id to leave out, or NULL);
    ``points``: ``wid, x, y, ...``. Ties go to the lesser ``wid``. A query with
    fewer than ``k`` others gets all.
    """
    sx, sy = scale
    n, x0, x1, y0, y1 = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    q0x, q1x, q0y, q1y = queries.agg(F.min("qx"), F.max("qx"), F.min("qy"), F.max("qy")).first()
    if not n or q0x is None:
        empty = queries.select("qid").join(points, F.lit(False))
        return empty.select("qid", *points.columns, F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
    extent = max((max(x1, q1x) - min(x0, q0x)) / sx, (max(y1, q1y) - min(y0, q0y)) / sy, 1e-9)
    width = max(max((x1 - x0) / sx, (y1 - y0) / sy, 1e-9) * ((k + 1) / max(n, 1)) ** 0.5, extent * 1e-6)
    at = lambda c, s, w: F.floor(F.col(c) / F.lit(s * w))
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i AS i, j AS j))))"))
    order = Window.partitionBy("qid").orderBy("dist", "wid")
    todo, done = queries, []
    for _ in range(max_rounds):
        cells = todo.select("*", at("qx", sx, width).alias("cx"), at("qy", sy, width).alias("cy"), around.alias("o"))
        placed = points.withColumns({"cx": at("x", sx, width), "cy": at("y", sy, width)})
        dist = F.sqrt(((F.col("qx") - F.col("x")) / F.lit(sx)) ** 2 + ((F.col("qy") - F.col("y")) / F.lit(sy)) ** 2)
        met = cells.withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).join(placed, ["cx", "cy"]).filter(~F.col("self").eqNullSafe(F.col("wid")))
        top = met.withColumn("dist", dist).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        whole = width > extent
        full = top.select("qid", *points.columns, "dist", "rank").withColumn("last", F.max(F.when(F.col("rank") == k, F.col("dist"))).over(Window.partitionBy("qid")))
        # Each round is written once; later rounds read it and not what made it.
        done.append(stored((full if whole else full.filter(F.col("last") <= width)).drop("last"), "near"))
        if whole:
            break
        todo = stored(todo.join(done[-1].filter("rank = 1").select("qid"), "qid", "left_anti").select(*queries.columns), "todo")
        if todo.isEmpty():
            break
        width *= 2
    return reduce(DataFrame.unionByName, done)


def plane_impute(queries: DataFrame, points: DataFrame, tops: list[str], k: int = 10) -> DataFrame:
    """Tops at each query by a weighted plane through its neighbours: ``qid, <tops>, min_dist``.

    Weights are 1 / (distance + 0.001). The plane is fitted around the query,
    so its level there is the prediction. Where the fit is singular the weighted
    mean stands in; a query without neighbours gets the mean of all points and
    no distance.
    """
    found = nearest(queries, points, k, scales(points))
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    w = F.col("w")
    near = found.join(queries.select("qid", "qx", "qy"), "qid").withColumn("w", 1 / (F.col("dist") + 1e-3)).withColumns({"dx": dx, "dy": dy})
    sums = {"s": w, "sx": w * F.col("dx"), "sy": w * F.col("dy"), "sxx": w * F.col("dx") ** 2, "sxy": w * F.col("dx") * F.col("dy"), "syy": w * F.col("dy") ** 2}
    right = {f"{p}_{t}": c * F.col(t) for t in tops for p, c in (("s", w), ("sx", w * F.col("dx")), ("sy", w * F.col("dy")))}
    m = near.groupBy("qid").agg(F.min("dist").alias("min_dist"), *[F.sum(c).alias(n) for n, c in (sums | right).items()])

    def level(t: str) -> Column:
        c = F.col
        a = [[c("sxx"), c("sxy"), c("sx")], [c("sxy"), c("syy"), c("sy")], [c("sx"), c("sy"), c("s")]]
        return F.coalesce(solve3(a, [c(f"sx_{t}"), c(f"sy_{t}"), c(f"s_{t}")], c("sxx") * c("syy") * c("s"))[2], c(f"s_{t}") / c("s"))

    overall = {r: v for r, v in points.agg(*[F.avg(t).alias(t) for t in tops]).first().asDict().items()}
    made = m.select("qid", "min_dist", *[level(t).alias(t) for t in tops])
    return queries.select("qid").join(made, "qid", "left").select("qid", *[F.coalesce(F.col(t), F.lit(overall[t]).cast("double")).alias(t) for t in tops], "min_dist")


def idw_impute(queries: DataFrame, points: DataFrame, value: str, k: int = 20, power: float = 2.0) -> DataFrame:
    """Inverse-distance weighted mean of the ``k`` nearest others; ``qid`` and ``value``."""
    found = nearest(queries, points, k, scales(points)).withColumn("w", 1 / (F.pow("dist", F.lit(power)) + 1e-9))
    return found.groupBy("qid").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def every_nth(rows: DataFrame, per_key: int, key: str = "well", order: str = "row_idx") -> DataFrame:
    """About ``per_key`` rows of each key, evenly spaced; ``order`` numbers rows from 0."""
    step = rows.groupBy(key).agg(F.greatest(F.lit(1), F.floor(F.count("*") / per_key)).alias("__step"))
    return rows.join(step, key).filter(F.col(order) % F.col("__step") == 0).drop("__step")
