"""Scalar expressions with defined null behaviour; a missing number is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float and double columns becomes NULL; NaN would poison averages and maxima."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name) for f in df.schema.fields])


def visible(c: str | Column = "TVT_input") -> Column:
    return col(c).isNotNull()


def hidden(c: str | Column = "TVT_input") -> Column:
    return col(c).isNull()


def round_even(c: str | Column, decimals: int = 0) -> Column:
    """Half-even rounding to decimals (Spark's ``round`` rounds half up)."""
    return F.rint(col(c) * 10**decimals) / 10**decimals if decimals else F.rint(col(c))


def close_to(a: str | Column, b: str | Column, atol: float = 1e-3, rtol: float = 1e-5) -> Column:
    """|a - b| <= atol + rtol |b|; false if either is missing."""
    return F.coalesce(F.abs(col(a) - col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(col(b)), F.lit(False))


def row_key(well: str | Column = "well", row: str | Column = "row_idx") -> Column:
    return F.concat_ws("_", col(well), col(row))


def lateral(dx: str | Column, dy: str | Column) -> Column:
    """Length of a horizontal step; a missing component counts as 0."""
    zero = F.lit(0.0)
    return F.sqrt(F.coalesce(col(dx), zero) ** 2 + F.coalesce(col(dy), zero) ** 2)


def inclination(dz: str | Column, lateral_step: str | Column) -> Column:
    return F.atan2(F.coalesce(col(dz), F.lit(0.0)), F.greatest(col(lateral_step), F.lit(1e-9)))


def ratio(n: str | Column, of: str | Column) -> Column:
    return col(n).cast("double") / F.greatest(col(of), F.lit(1))


def det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def solve3(m: list[list[Column]], r: list[Column], scale: Column, tiny: float = 1e-12) -> list[Column]:
    """Cramer's rule for three unknowns; NULL where the determinant is tiny against ``scale``."""
    d = det3(m)
    ok = F.abs(d) > F.lit(tiny) * scale
    return [F.when(ok, det3([[r[i] if k == j else m[i][k] for k in range(3)] for i in range(3)]) / d) for j in range(3)]


def correlation(a: str | Column, b: str | Column, over: object | None = None) -> Column:
    """Pearson correlation of pairs that are there; NULL where one side does not vary."""
    a, b = col(a), col(b)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    size = at(F.stddev_pop(x)) * at(F.stddev_pop(y))
    return F.when(size > 0, at(F.covar_pop(x, y)) / F.when(size > 0, size))
