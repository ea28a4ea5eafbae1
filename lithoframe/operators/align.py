"""Relating a log to its typewell: interpolation, offsets, calibration, matching.

A typewell is a table of segments, each from one depth to the next. A depth
finds its segment by an equi-join on buckets of depth, not by comparing every
depth with every segment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(t: DataFrame, key: list[str] | None = None, bucket: float = 64.0) -> DataFrame:
    """Typewell rows with the next row's depth and GR, once for each bucket they touch. The ends reach out to hold all depths."""
    w = (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy("TVT")
    s = t.select(*(key or []), "TVT", "GR", F.lead("TVT").over(w).alias("TVT_next"), F.lead("GR").over(w).alias("GR_next"))
    return s.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("TVT") / bucket), F.floor(F.coalesce("TVT_next", "TVT") / bucket)))).withColumnsRenamed({"TVT": "t0", "GR": "g0", "TVT_next": "t1", "GR_next": "g1"})


def interpolate(rows: DataFrame, at: str, t: DataFrame, out: str = "tw_gr", key: list[str] | None = None, bucket: float = 64.0) -> DataFrame:
    """``rows`` with the typewell's GR at depth ``at``, linear between rows and constant beyond the ends; NULL for a NULL depth."""
    key = key or []
    ends = t.groupBy(*key).agg(F.min("TVT").alias("lo"), F.max("TVT").alias("hi"))
    if key:
        placed = rows.join(ends, key)
    else:
        lo, hi = ends.first()
        placed = rows.withColumns({"lo": F.lit(lo).cast("double"), "hi": F.lit(hi).cast("double")})
    depth = F.greatest(F.least(F.col(at), F.col("hi")), F.col("lo"))
    placed = placed.withColumn("__d", F.when(F.col(at).isNotNull(), depth)).withColumn("bucket", F.floor(F.col("__d") / bucket))
    s = segments(t, key or None, bucket)
    inside = (F.col("__d") >= F.col("t0")) & ((F.col("__d") < F.col("t1")) | F.col("t1").isNull())
    on = [placed["bucket"] == s["bucket"], *[placed[k] == s[k] for k in key]]
    met = placed.join(s, [*on, inside], "left")
    value = F.when(F.col("t1").isNull(), F.col("g0")).otherwise(F.col("g0") + (F.col("g1") - F.col("g0")) * (F.col("__d") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return met.select(*[placed[c] for c in rows.columns], value.alias(out))


# Offsets in feet around an anchor, by anchor: fixed values.
OFFSETS = {
    "anchor": [-80, -40, -20, -10, -5, 0, 5, 10, 20, 40, 80],
    "beam": [-40, -20, -10, -5, -3, 0, 3, 5, 10, 20, 40],
    "self": [-30, -15, -8, -4, -2, 0, 2, 4, 8, 15, 30],
    "particle": [-30, -15, -8, -4, -2, 0, 2, 4, 8, 15, 30],
}


def offset_bank(rows: DataFrame, anchor: str, t: DataFrame, family: str = "anchor", id_cols: tuple[str, ...] = ("well", "row_idx"), key: list[str] | None = None) -> DataFrame:
    """Per row, GR minus the typewell's GR at the anchor plus each offset, as columns ``tw_diff_<n>``."""
    steps = OFFSETS[family]
    spread = rows.select(*id_cols, "GR", anchor, *[k for k in key or [] if k not in id_cols], F.explode(F.array(*map(F.lit, steps))).alias("offset")).withColumn("__at", F.col(anchor) + F.col("offset"))
    found = interpolate(spread, "__at", t, "tw_gr", key)
    named = {o: f"tw_diff_{'m' if o < 0 else 'p'}{abs(o)}" for o in steps}
    return found.groupBy(*id_cols).agg(*[F.max(F.when(F.col("offset") == o, F.col("GR") - F.col("tw_gr"))).alias(n) for o, n in named.items()])


def affine_calibration(pairs: DataFrame, key: str = "well", gr: str = "GR", tw: str = "tw_gr", least: int = 20) -> DataFrame:
    """``GR = a tw + b`` by least squares; with few points or a flat typewell ``a`` is 1 and ``b`` the difference of means (0 without points)."""
    both = F.col(gr).isNotNull() & F.col(tw).isNotNull()
    y, x = F.when(both, F.col(gr)), F.when(both, F.col(tw))
    m = pairs.groupBy(key).agg(F.count(x).alias("n"), F.stddev_pop(x).alias("sd"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("level"), (F.avg(gr) - F.avg(tw)).alias("shift"))
    plain = (F.col("n") < least) | F.col("sd").isNull() | (F.col("sd") < 1e-6)
    return m.select(key, F.when(plain, F.lit(1.0)).otherwise(F.col("slope")).alias("a_cal"), F.when(F.col("n") == 0, F.lit(0.0)).when(plain, F.coalesce("shift", F.lit(0.0))).otherwise(F.col("level")).alias("b_cal"))


def nearest_value(rows: DataFrame, anchor: str, t: DataFrame, reach: float = 40.0, id_cols: tuple[str, ...] = ("well", "row_idx"), key: list[str] | None = None) -> DataFrame:
    """Per row, the typewell depth within ``reach`` of the anchor whose GR is nearest to the row's; ties go to the lesser depth."""
    bucket = 2 * reach
    key = key or []
    r = rows.filter(F.col("GR").isNotNull()).select(*id_cols, "GR", anchor, *[k for k in key if k not in id_cols])
    spread = r.withColumn("bucket", F.explode(F.sequence(F.floor((F.col(anchor) - reach) / bucket), F.floor((F.col(anchor) + reach) / bucket))))
    placed = t.select(*key, F.col("TVT").alias("t0"), F.col("GR").alias("g0"), F.floor(F.col("TVT") / bucket).alias("bucket"))
    met = spread.join(placed, ["bucket", *key]).filter((F.abs(F.col("t0") - F.col(anchor)) <= reach) & F.col("g0").isNotNull())
    return met.groupBy(*id_cols, anchor).agg(F.min(F.struct(F.abs(F.col("GR") - F.col("g0")).alias("gap"), "t0")).alias("m")).select(*id_cols, F.col("m.t0").alias("matched_tvt"), (F.col("m.t0") - F.col(anchor)).alias("shift"))


def match_shift(matched: DataFrame, key: str = "well") -> DataFrame:
    return matched.groupBy(key).agg(F.median("shift").alias("ncc_med_shift"), F.avg("shift").alias("ncc_mean_shift"))


# Endpoint offsets in feet: fixed values (17, from -120 to 120).
ENDPOINTS = [-120, -80, -60, -40, -30, -20, -10, -5, 0, 5, 10, 20, 30, 40, 60, 80, 120]


def ease_paths(hidden_rows: DataFrame, anchor: str, t: DataFrame, key: str = "well", order: str = "row_idx") -> DataFrame:
    """For each endpoint, a path that eases from the anchor to anchor plus endpoint over the hidden rows, and its mean absolute GR error."""
    ends = hidden_rows.groupBy(key).agg(F.min(order).alias("__a"), F.count("*").alias("__n"))
    frac = (F.col(order) - F.col("__a")) / F.greatest(F.col("__n") - 1, F.lit(1))
    ease = 3 * frac**2 - 2 * frac**3
    spread = hidden_rows.join(ends, key).select(key, order, "GR", F.explode(F.array(*map(F.lit, ENDPOINTS))).alias("endpoint"), ease.alias("ease"), anchor)
    found = interpolate(spread.withColumn("__at", F.col(anchor) + F.col("endpoint") * F.col("ease")), "__at", t)
    return found.groupBy(key, "endpoint").agg(F.avg(F.abs(F.col("GR") - F.col("tw_gr"))).alias("path_abs"))


def best_endpoint(paths: DataFrame, key: str = "well", tau: float = 5.0) -> DataFrame:
    """Best offset, gap to the second best error, and the soft weighted mean offset. A group has 17 rows."""
    best = F.array_sort(F.collect_list(F.struct("path_abs", "endpoint")))
    soft = F.exp(-F.col("path_abs") / tau)
    return paths.groupBy(key).agg(best.alias("b"), (F.sum(soft * F.col("endpoint")) / F.sum(soft)).alias("soft_endpoint")).select(key, F.col("b")[0]["endpoint"].alias("best_endpoint"), (F.col("b")[1]["path_abs"] - F.col("b")[0]["path_abs"]).alias("gap"), "soft_endpoint")


def boundaries(t: DataFrame, key: list[str] | None = None, label: str = "Geology") -> DataFrame:
    """Depths at which the label changes."""
    w = (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy("TVT")
    return t.withColumn("__before", F.lag(label).over(w)).filter(F.col(label) != F.col("__before")).select(*(key or []), F.col("TVT").alias("boundary"))


def boundary_distance(rows: DataFrame, at: str, t: DataFrame, key: list[str] | None = None, out: str = "boundary_dist", nearest: str | None = None, bucket: float = 64.0) -> DataFrame:
    """``rows`` with the distance from depth ``at`` to the nearest boundary and, if named, that boundary as ``nearest``.

    Of two that are as near, the lesser. NULL without boundaries or depth. A
    depth finds the two boundaries around it by an equi-join on buckets of depth.
    """
    key = key or []
    cuts = boundaries(t, key or None).distinct()
    w = (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy("boundary")
    spans = cuts.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("boundary").alias("__l"), F.lead("boundary").over(w).alias("__r"))
    spans = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__l") / bucket), F.floor(F.coalesce("__r", "__l") / bucket))))
    ends = cuts.groupBy(*key).agg(F.min("boundary").alias("__lo"), F.max("boundary").alias("__hi"))
    if key:
        placed = rows.join(ends, key, "left").select(*rows.columns, "__lo", "__hi")
    else:
        lo, hi = ends.first()
        placed = rows.withColumns({"__lo": F.lit(lo).cast("double"), "__hi": F.lit(hi).cast("double")})
    inner = F.when(F.col(at).isNotNull(), F.greatest(F.least(F.col(at), F.col("__hi")), F.col("__lo")))
    placed = placed.withColumn("__d", inner).withColumn("__at", F.floor(F.col("__d") / bucket))
    inside = (F.col("__d") >= F.col("__l")) & ((F.col("__d") < F.col("__r")) | F.col("__r").isNull())
    met = placed.join(spans, [F.col("__at") == F.col("__cell"), *[F.col(k) == F.col(f"__{k}") for k in key], inside], "left")
    left = F.col("__r").isNull() | (F.col(at) - F.col("__l") <= F.col("__r") - F.col(at))
    near = F.when(left, F.col("__l")).otherwise(F.col("__r"))
    return met.select(*[F.col(c) for c in rows.columns], F.abs(F.col(at) - near).alias(out), *([near.alias(nearest)] if nearest else []))


def resample(t: DataFrame, step: float = 1.0, key: list[str] | None = None) -> DataFrame:
    """Typewell at whole steps of depth within its range, by interpolation."""
    key = key or []
    ends = t.groupBy(*key).agg(F.ceil(F.min("TVT") / step).alias("a"), F.floor(F.max("TVT") / step).alias("b"))
    grid = ends.select(*key, F.explode(F.sequence("a", "b")).alias("i")).select(*key, (F.col("i") * step).alias("TVT"))
    return interpolate(grid, "TVT", t, "GR", key or None)


# Offsets in feet of the local correlation's search.
SEARCH = list(range(-120, 121))


def _pair_correlation(x: np.ndarray, y: np.ndarray, half: int) -> np.ndarray:
    """Correlation of a log ``x`` with each column of ``y`` over the rows within ``half``, of pairs that are there; NaN where one side does not vary."""
    ok = np.isfinite(x)[:, None] & np.isfinite(y)
    centre = lambda v: v - (np.nanmean(v) if np.isfinite(v).any() else 0.0)
    x, y = np.where(ok, centre(x)[:, None], 0.0), np.where(ok, centre(y), 0.0)
    n, width = len(ok), 2 * half + 1

    def near(v: np.ndarray) -> np.ndarray:
        """Sums over windows, put together from sums of 1, 2, 4 .. rows: a running sum over all rows would lose a small window's digits."""
        v = np.concatenate([np.zeros((half, v.shape[1])), v, np.zeros((half, v.shape[1]))])
        total, at = np.zeros((n, v.shape[1])), 0
        for bit in range(width.bit_length()):
            if width >> bit & 1:
                total += v[at : at + n]
                at += 1 << bit
            if width >> bit + 1:
                v = v[: -1 << bit] + v[1 << bit :]
        return total

    m = np.maximum(near(ok.astype(float)), 1)
    sx, sy = near(x), near(y)
    vx, vy = near(x * x) - sx * sx / m, near(y * y) - sy * sy / m
    flat = (vx <= 1e-9 * m) | (vy <= 1e-9 * m)
    return np.where(flat, np.nan, (near(x * y) - sx * sy / m) / np.sqrt(np.where(flat, 1, vx * vy)))


def shifted_correlation(rows: DataFrame, anchor: str, t: DataFrame, offsets: list[int], key: str = "well", order: str = "row_idx", half: int = 15, segment: int = 2048, bucket: float = 64.0) -> DataFrame:
    """Per row, the offset whose typewell GR correlates best with GR over the rows within ``half``: ``xcorr_best_corr, xcorr_tvt_delta, xcorr_best_absdiff``.

    Correlations that agree to nine places tie; the offset nearest to 0 wins,
    then the larger. Rows for which no offset has a correlation are left out. A
    well is dealt in segments, which also get the ``half`` rows on either side
    and the stretch of the typewell that their depths reach; ``order`` numbers
    a well's rows from 0 without gaps.
    """
    own = F.floor(F.col(order) / segment)
    at = F.col(order) % segment
    cells = F.array_distinct(F.array(own, F.when(at < half, F.greatest(own - 1, F.lit(0))).when(at >= segment - half, own + 1).otherwise(own)))
    dealt = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col("GR").cast("double").alias("gr"), F.col(anchor).cast("double").alias("at"), F.explode(cells).alias("cell"))
    lo, hi = t.agg(F.min("TVT"), F.max("TVT")).first()
    held = lambda c: F.greatest(F.least(c, F.lit(hi).cast("double")), F.lit(lo).cast("double"))
    reach = dealt.groupBy("key", "cell").agg(held(F.min("at") + min(offsets)).alias("a"), held(F.max("at") + max(offsets)).alias("b"))
    wanted = reach.filter("a is not null").select("key", "cell", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor(F.col("b") / bucket))).alias("bucket"))
    parts = segments(t, None, bucket).join(wanted, "bucket").select(F.col("key").alias("of_key"), F.col("cell").alias("of_cell"), "t0", "g0", "t1", "g1").distinct()
    kind = dict(rows.dtypes)
    steps = np.array(offsets, float)
    rank = np.lexsort((-steps, np.abs(steps)))

    def best(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p, q = p.sort_values("order", kind="stable"), q.sort_values("t0", kind="stable")
        names = ["key", "order", "xcorr_best_corr", "xcorr_tvt_delta", "xcorr_best_absdiff"]
        if not len(q) or not len(p):
            return pd.DataFrame(columns=names)
        last = q.iloc[-1]
        xs, ys = q["t0"].to_numpy(float), q["g0"].to_numpy(float)
        if np.isfinite(last["t1"]):
            xs, ys = np.append(xs, last["t1"]), np.append(ys, last["g1"])
        gr, depth = p["gr"].to_numpy(float), p["at"].to_numpy(float)[:, None] + steps[rank]
        tw = np.where(np.isfinite(depth), np.interp(depth, xs, ys), np.nan)
        c = np.round(_pair_correlation(gr, tw, half), 9)
        found = np.isfinite(c).any(axis=1) & (p["order"].to_numpy() // segment == p["cell"].to_numpy())
        at = np.where(np.isfinite(c), c, -np.inf).argmax(axis=1)
        line = np.arange(len(p))
        out = pd.DataFrame({"key": p["key"].to_numpy(), "order": p["order"].to_numpy(), names[2]: c[line, at], names[3]: steps[rank][at].astype(int), names[4]: np.abs(gr - tw[line, at])})
        return out[found]

    schema = f"key {kind[key]}, order {kind[order]}, xcorr_best_corr double, xcorr_tvt_delta int, xcorr_best_absdiff double"
    made = dealt.groupBy("key", "cell").cogroup(parts.groupBy("of_key", "of_cell")).applyInPandas(best, schema)
    return made.withColumnsRenamed({"key": key, "order": order})
