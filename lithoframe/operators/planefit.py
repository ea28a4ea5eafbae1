"""Least-squares planes per well: TVT = a X + b Y + c Z + d over visible rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.scalar import solve3

COEFFICIENTS = ["pf_a", "pf_b", "pf_c", "pf_d"]


def moment_aggregates(target: str = "TVT_input", axes: tuple[str, str, str] = ("X", "Y", "Z")) -> list[Column]:
    """Centred moments over rows where the target is there; one pass, merged map-side."""
    seen = F.col(target).isNotNull()
    v = {c: F.when(seen, F.col(c)) for c in (*axes, target)}
    pairs = [(a, b) for i, a in enumerate(axes) for b in (*axes[i:], target)]
    return [F.count(target).alias("m_n"), *[F.avg(v[c]).alias(f"m_{c}") for c in (*axes, target)], *[F.covar_pop(v[a], v[b]).alias(f"m_{a}_{b}") for a, b in pairs]]


def solve_moments(target: str = "TVT_input", axes: tuple[str, str, str] = ("X", "Y", "Z")) -> dict[str, Column]:
    """Coefficients from the moments, centred: fewer than four points give the mean, no point 0, a singular fit the mean too."""
    c = lambda a, b: F.col(f"m_{a}_{b}") if axes.index(a) <= (axes.index(b) if b in axes else 9) else F.col(f"m_{b}_{a}")
    m = [[c(a, b) for b in axes] for a in axes]
    scale = F.col(f"m_{axes[0]}_{axes[0]}") * F.col(f"m_{axes[1]}_{axes[1]}") * F.col(f"m_{axes[2]}_{axes[2]}")
    slopes = [F.coalesce(F.when(F.col("m_n") >= 4, s), F.lit(0.0)) for s in solve3(m, [c(a, target) for a in axes], scale)]
    level = F.coalesce(F.col(f"m_{target}"), F.lit(0.0))
    for s, a in zip(slopes, axes, strict=True):
        level = level - s * F.coalesce(F.col(f"m_{a}"), F.lit(0.0))
    return dict(zip(COEFFICIENTS, [*slopes, level], strict=True))


def plane_fit(df: DataFrame, key: str = "well", target: str = "TVT_input") -> DataFrame:
    """One row per well: ``pf_a .. pf_d`` by centred moments."""
    return df.groupBy(key).agg(*moment_aggregates(target)).select(key, *[c.alias(n) for n, c in solve_moments(target).items()])


def predict(x: str = "X", y: str = "Y", z: str = "Z") -> Column:
    """The plane at a row; extrapolates into hidden rows."""
    return F.col("pf_a") * F.col(x) + F.col("pf_b") * F.col(y) + F.col("pf_c") * F.col(z) + F.col("pf_d")


def plane_fit_lstsq(df: DataFrame, key: str = "well", order: str = "row_idx", target: str = "TVT_input", parts: int = 16) -> DataFrame:
    """As ``plane_fit``, by the minimum-norm least-squares solution of the uncentred system.

    Each part of a well is reduced to a triangular factor of its rows, and the
    factors of a well are solved together, so a well of any length is spread
    over ``parts`` tasks and only 5 x 5 matrices meet.
    """
    names = [f"r{i}" for i in range(25)]

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[["X", "Y", "Z"]].to_numpy(float)
        a = np.column_stack([rows, np.ones(len(rows)), pdf[target].to_numpy(float)])
        r = np.zeros((5, 5))
        q = np.linalg.qr(a, mode="r")
        r[: len(q)] = q
        return pd.DataFrame([[pdf[key].iloc[0], len(rows), float(pdf[target].sum()), *r.ravel()]], columns=[key, "n", "total", *names])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        if n < 4:
            coef = [0.0, 0.0, 0.0, float(pdf["total"].sum() / n)]
        else:
            r = np.linalg.qr(pdf[names].to_numpy().reshape(-1, 5), mode="r")
            coef = np.linalg.lstsq(r[:, :4], r[:, 4], rcond=np.finfo(float).eps * max(n, 4))[0].tolist()
        return pd.DataFrame([[pdf[key].iloc[0], *coef]], columns=[key, *COEFFICIENTS])

    kind = dict(df.dtypes)[key]
    seen = df.filter(F.col(target).isNotNull()).select(key, order, "X", "Y", "Z", target).withColumn("__part", F.pmod(F.col(order), F.lit(parts)))
    reduced = seen.groupBy(key, "__part").applyInPandas(lambda p: factor(p), f"{key} {kind}, n long, total double, " + ", ".join(f"{n} double" for n in names))
    solved = reduced.groupBy(key).applyInPandas(solve, f"{key} {kind}, " + ", ".join(f"{c} double" for c in COEFFICIENTS))
    return df.select(key).distinct().join(solved, key, "left").fillna(0.0, COEFFICIENTS)
