"""Combining predictions of several models. Tables are long (``well, row_idx, model, pred``) or have a column per model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ID = ["well", "row_idx"]


def median_ensemble(long: DataFrame, ids: list[str] | None = None) -> DataFrame:
    return long.groupBy(*(ids or ID)).agg(F.median("pred").alias("pred"))


def mean_ensemble(long: DataFrame, ids: list[str] | None = None) -> DataFrame:
    return long.groupBy(*(ids or ID)).agg(F.avg("pred").alias("pred"))


def weighted_median(long: DataFrame, weight: str = "weight", ids: list[str] | None = None) -> DataFrame:
    """The least prediction at which the weights up to it reach half of all; a group has one row per model."""
    ids = ids or ID
    w = Window.partitionBy(*ids).orderBy("pred", "model")
    reached = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) * 2 >= F.sum(weight).over(Window.partitionBy(*ids))
    return long.withColumn("__r", reached).filter("__r").groupBy(*ids).agg(F.min("pred").alias("pred"))


def gram(wide: DataFrame, models: list[str], target: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Products of all models and the target, summed over rows with all of them: k x k numbers reach the driver."""
    names = [*models, target]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = wide.na.drop(subset=names).agg(F.count("*"), *[F.sum(F.col(names[i]).cast("double") * F.col(names[j])) for i, j in pairs]).first()
    g = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        g[i, j] = g[j, i] = v or 0.0
    k = len(models)
    return g[:k, :k], g[:k, k], g[k, k], row[0]


def nonnegative_ridge(a: np.ndarray, b: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Weights w >= 0 that minimise w'(a + alpha I)w - 2 b'w, by an active set."""
    a = a + alpha * np.eye(len(a))
    w, active = np.zeros(len(b)), np.zeros(len(b), bool)
    for _ in range(30 * len(b) + 30):
        slope = b - a @ w
        if active.all() or slope[~active].max() <= 1e-13 * max(1.0, np.abs(b).max()):
            break
        active[np.argmax(np.where(active, -np.inf, slope))] = True
        while True:
            s = np.zeros(len(b))
            s[active] = np.linalg.solve(a[np.ix_(active, active)], b[active])
            if not active.any() or s[active].min() > 0:
                w = s
                break
            low = active & (s <= 0)
            step = (w[low] / np.maximum(w[low] - s[low], 1e-300)).min()
            w = w + step * (s - w)
            active &= w > 1e-12
            w[~active] = 0
    return w


def stack(wide: DataFrame, models: list[str], target: str, alpha: float = 1.0) -> dict[str, float]:
    a, b, _, _ = gram(wide, models, target)
    return dict(zip(models, nonnegative_ridge(a, b, alpha).tolist(), strict=True))


def blended(wide: DataFrame, weights: dict[str, float], out: str = "pred") -> DataFrame:
    total = sum((F.lit(w) * F.col(m) for m, w in weights.items()), F.lit(0.0))
    return wide.withColumn(out, total)


def rmse_of(weights: np.ndarray, a: np.ndarray, b: np.ndarray, yy: float, n: int) -> float:
    return float(np.sqrt(max(0.0, weights @ a @ weights - 2 * b @ weights + yy) / max(n, 1)))


def hill_climb(wide: DataFrame, models: list[str], target: str, step: float = 0.05, rounds: int = 500) -> dict[str, float]:
    """Greedy steps of weight from one model to another while RMSE falls, starting from the best model; all from the product matrix."""
    a, b, yy, n = gram(wide, models, target)
    k = len(models)
    w = np.eye(k)[min(range(k), key=lambda i: rmse_of(np.eye(k)[i], a, b, yy, n))]
    best = rmse_of(w, a, b, yy, n)
    for _ in range(rounds):
        moves = [w + step * (np.eye(k)[i] - np.eye(k)[j]) for i in range(k) for j in range(k) if i != j and w[j] >= step - 1e-12]
        if not moves:
            break
        scores = [rmse_of(m, a, b, yy, n) for m in moves]
        if min(scores) >= best - 1e-12:
            break
        best = min(scores)
        w = moves[int(np.argmin(scores))]
    return dict(zip(models, np.round(w, 10).tolist(), strict=True))


def keep_best(wide: DataFrame, models: list[str], target: str, alpha: float = 1.0) -> tuple[str, dict[str, float]]:
    """The stack if its RMSE is below that of the plain mean, else the mean."""
    a, b, yy, n = gram(wide, models, target)
    s, m = nonnegative_ridge(a, b, alpha), np.full(len(models), 1 / len(models))
    name, w = ("stack", s) if rmse_of(s, a, b, yy, n) < rmse_of(m, a, b, yy, n) else ("mean", m)
    return name, dict(zip(models, w.tolist(), strict=True))
