"""Registered queries and their DuckDB equivalents.

Doubles are rounded here and in the SQL with one shift, so that a value on a
decimal tie does not differ by its last bit; operators never round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoframe.functions import scalar
from lithoframe.operators import align, blend, crossval, knn, paths, planefit, post, profile, sequence, statistics
from lithoframe.plans import features
from lithoframe.plans.fixtures import EV, POINTS, TOPS, TW, USER, USER_TW, point_queries, points, table, typewell, user_typewells, well_ev, well_files, well_user
from lithoframe.sources import scratch, wells
from lithoframe.streaming import causal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f.name) + 3.7e-9, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def R(e: str) -> str:
    return f"round(({e}) + 3.7e-9, 6)"


def RS(*names: str) -> str:
    return ", ".join(f"{R(n)} AS {n}" for n in names)


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda s, d: tidy(run(s, d))
    if sql:
        ORACLES[name] = sql


ID = ["well", "row_idx"]
W = sequence.by  # called in a query, as it needs a session
OVER = "OVER (PARTITION BY well ORDER BY row_idx)"


def frame(k: int, lead: int = 0) -> str:
    return f"OVER (PARTITION BY well ORDER BY row_idx ROWS BETWEEN {k} PRECEDING AND {f'{lead} FOLLOWING' if lead else 'CURRENT ROW'})"


def windows(df: DataFrame, columns: dict) -> DataFrame:
    return df.select(*ID, *[c.alias(n) for n, c in columns.items()])


# Scans, filters, keys.
add("scan_union", lambda s, d: wells.union_splits(well_user(s, d).filter("split = 'train'").drop("split"), well_user(s, d).filter("split = 'test'").drop("split", "TVT")).select(*ID, "split", "MD", "GR", "TVT"), f"WITH {USER} SELECT well, row_idx, split, {RS('MD', 'GR', 'TVT')} FROM us")
add("hidden_filter", lambda s, d: well_ev(s, d).filter(scalar.hidden()).select(*ID, "MD", "TVT"), f"WITH {EV} SELECT well, row_idx, {RS('MD', 'TVT')} FROM ev WHERE TVT_input IS NULL")
add("visible_filter", lambda s, d: well_ev(s, d).filter(scalar.visible()).select(*ID, "TVT_input"), f"WITH {EV} SELECT well, row_idx, {RS('TVT_input')} FROM ev WHERE TVT_input IS NOT NULL")
add("drop_nulls", lambda s, d: well_ev(s, d).na.drop(subset=["GR", "TVT_input"]).select(*ID, "GR", "TVT_input"), f"WITH {EV} SELECT well, row_idx, {RS('GR', 'TVT_input')} FROM ev WHERE GR IS NOT NULL AND TVT_input IS NOT NULL")
add("projected_scan", lambda s, d: well_ev(s, d).select("well", "X", "Y"), f"WITH {EV} SELECT well, {RS('X', 'Y')} FROM ev")
add("list_wells", lambda s, d: well_user(s, d).select("well").distinct().orderBy("well"), f"WITH {USER} SELECT DISTINCT well FROM us ORDER BY well")
add("submission_ids", lambda s, d: wells.submission_template(well_ev(s, d)), f"WITH {EV} SELECT well || '_' || row_idx AS id, 0.0::DOUBLE AS tvt FROM ev WHERE TVT_input IS NULL")
add("predictions_for_ids", lambda s, d: crossval.predictions_for(wells.submission_template(well_ev(s, d)), well_ev(s, d).filter("row_idx % 3 = 0").select(scalar.row_key().alias("id"), F.col("MD").alias("tvt")), -1.0), f"WITH {EV} SELECT well || '_' || row_idx AS id, {R('CASE WHEN row_idx % 3 = 0 THEN MD ELSE -1 END')} AS tvt FROM ev WHERE TVT_input IS NULL")
add("depth_ties", lambda s, d: wells.duplicate_depths(well_ev(s, d).withColumn("MD", F.floor(F.col("MD") / 2))), f"WITH {EV} SELECT well, count(*) AS n, count(DISTINCT floor(MD / 2)) AS depths FROM ev GROUP BY well HAVING count(*) > count(DISTINCT floor(MD / 2))")
add("rounding", lambda s, d: well_ev(s, d).select(*ID, scalar.round_even(F.col("X") / 2).alias("half"), (F.col("Z") / 3).cast("int").alias("cut")), f"WITH {EV} SELECT well, row_idx, round_even(X / 2, 0) AS half, CAST(trunc(Z / 3) AS INTEGER) AS cut FROM ev")

# Windows.
for k in sequence.ROLL_WINDOWS:
    add(f"roll_mean_{k}", lambda s, d, k=k: windows(well_ev(s, d), {"v": sequence.roll_mean("GR", k, W())}), f"WITH {EV} SELECT well, row_idx, {R(f'avg(GR) {frame(k - 1)}')} AS v FROM ev")
    add(f"roll_std_{k}", lambda s, d, k=k: windows(well_ev(s, d), {"v": sequence.roll_std("GR", k, W())}), f"WITH {EV} SELECT well, row_idx, {R(f'coalesce(stddev_samp(GR) {frame(k - 1)}, 0)')} AS v FROM ev")
for k in sequence.DIFF_LAGS:
    add(f"gr_diff_{k}", lambda s, d, k=k: windows(well_ev(s, d), sequence.diffs("GR", W(), [k])), f"WITH {EV} SELECT well, row_idx, {R(f'GR - lag(GR, {k}) {OVER}')} AS GR_diff_{k} FROM ev")
add("roll_segmented", lambda s, d: sequence.segmented(well_ev(s, d), lambda w: {"v": sequence.roll_mean("GR", 50, w)}, 50, rows=137).select(*ID, "v"), f"WITH {EV} SELECT well, row_idx, {R(f'avg(GR) {frame(49)}')} AS v FROM ev")
add("roll_users", lambda s, d: windows(well_user(s, d), sequence.rolling("GR", W())), f"WITH {USER} SELECT well, row_idx, " + ", ".join(f"{R(f'avg(GR) {frame(k - 1)}')} AS GR_roll_mean_{k}, {R(f'coalesce(stddev_samp(GR) {frame(k - 1)}, 0)')} AS GR_roll_std_{k}" for k in sequence.ROLL_WINDOWS) + " FROM us")
DERIV = f"""der AS (SELECT *, X - lag(X) {OVER} AS dX, Y - lag(Y) {OVER} AS dY, Z - lag(Z) {OVER} AS dZ, Z - 2 * lag(Z) {OVER} + lag(Z, 2) {OVER} AS d2Z FROM ev),
    der2 AS (SELECT *, sqrt(coalesce(dX, 0) ** 2 + coalesce(dY, 0) ** 2) AS lateral_velocity FROM der),
    der3 AS (SELECT *, atan2(coalesce(dZ, 0), greatest(lateral_velocity, 1e-9)) AS inclination FROM der2)"""
add("traj_deriv", lambda s, d: windows(well_ev(s, d), {k: v for k, v in sequence.derivatives(W()).items() if k in ("dX", "dY", "dZ", "d2Z")}), f"WITH {EV}, {DERIV} SELECT well, row_idx, {RS('dX', 'dY', 'dZ', 'd2Z')} FROM der3")
add("inclination", lambda s, d: windows(well_ev(s, d), {k: v for k, v in sequence.derivatives(W()).items() if k in ("lateral_velocity", "inclination")}), f"WITH {EV}, {DERIV} SELECT well, row_idx, {RS('lateral_velocity', 'inclination')} FROM der3")
add("centred_roll", lambda s, d: windows(well_ev(s, d), sequence.centred("GR", W())), f"WITH {EV} SELECT well, row_idx, " + ", ".join(f"{R(f'avg(GR) {frame(k // 2, k // 2)}')} AS GR_centred_{k}" for k in (5, 21, 51, 101)) + " FROM ev")
add("lag_lead", lambda s, d: windows(well_ev(s, d), sequence.shifts("GR", W())), f"WITH {EV} SELECT well, row_idx, " + ", ".join(f"{R(f'{f}(GR, {k}) {OVER}')} AS GR_{f}_{k}" for f in ("lag", "lead") for k in (1, 5, 15, 30)) + " FROM ev")
def _product(s, d):
    return sequence.cumulative_product(well_ev(s, d), W()).select(*ID, "dZ_prod_sign", "dZ_prod_log")


add("cumulative_product", _product, f"WITH {EV}, st AS (SELECT well, row_idx, Z - lag(Z) {OVER} AS d FROM ev) SELECT well, row_idx, CAST(CASE WHEN sum((d = 0)::INTEGER) {OVER} > 0 THEN 0 ELSE 1 - 2 * (sum((d < 0)::INTEGER) {OVER} % 2) END AS INTEGER) AS dZ_prod_sign, {R(f'sum(CASE WHEN d <> 0 THEN ln(abs(d)) END) {OVER}')} AS dZ_prod_log FROM st")
add("cumulative", lambda s, d: windows(well_ev(s, d), sequence.cumulative(W())), f"WITH {EV} SELECT well, row_idx, {R(f'sum(GR) {OVER}')} AS GR_cumsum, {R(f'abs(Z - lag(Z) {OVER})')} AS dZ_abs FROM ev")
STEPS = ", ".join(f"{c} - lag({c}) {OVER} AS now_{c}, lag({c}) {OVER} - lag({c}, 2) {OVER} AS old_{c}" for c in "XYZ")
add("dogleg", lambda s, d: windows(well_ev(s, d), sequence.dogleg(W())), f"""WITH {EV}, st AS (SELECT well, row_idx, {STEPS} FROM ev),
    m AS (SELECT *, (now_X * old_X) + (now_Y * old_Y) + (now_Z * old_Z) AS inner_, sqrt((now_X ** 2) + (now_Y ** 2) + (now_Z ** 2)) * sqrt((old_X ** 2) + (old_Y ** 2) + (old_Z ** 2)) AS size FROM st)
    SELECT well, row_idx, {R('CASE WHEN size > 0 THEN acos(greatest(-1.0, least(1.0, inner_ / size))) END')} AS dogleg FROM m""")

# Constants of a well and the feature table.
PF = """pf0 AS (SELECT well, count(TVT_input) AS n, avg(X) FILTER (TVT_input IS NOT NULL) AS mx, avg(Y) FILTER (TVT_input IS NOT NULL) AS my, avg(Z) FILTER (TVT_input IS NOT NULL) AS mz, avg(TVT_input) AS mt,
        covar_pop(X, X) FILTER (TVT_input IS NOT NULL) AS xx, covar_pop(X, Y) FILTER (TVT_input IS NOT NULL) AS xy, covar_pop(X, Z) FILTER (TVT_input IS NOT NULL) AS xz, covar_pop(Y, Y) FILTER (TVT_input IS NOT NULL) AS yy,
        covar_pop(Y, Z) FILTER (TVT_input IS NOT NULL) AS yz, covar_pop(Z, Z) FILTER (TVT_input IS NOT NULL) AS zz, covar_pop(X, TVT_input) AS xt, covar_pop(Y, TVT_input) AS yt, covar_pop(Z, TVT_input) AS zt FROM ev GROUP BY well),
    pf1 AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM pf0),
    pf2 AS (SELECT *, n >= 4 AND abs(det) > 1e-12 * xx * yy * zz AS ok FROM pf1),
    pf3 AS (SELECT well, mx, my, mz, coalesce(mt, 0) AS mt, CASE WHEN ok THEN (xt * (yy * zz - yz * yz) - xy * (yt * zz - yz * zt) + xz * (yt * yz - yy * zt)) / det ELSE 0 END AS pf_a,
        CASE WHEN ok THEN (xx * (yt * zz - yz * zt) - xt * (xy * zz - yz * xz) + xz * (xy * zt - yt * xz)) / det ELSE 0 END AS pf_b, CASE WHEN ok THEN (xx * (yy * zt - yt * yz) - xy * (xy * zt - yt * xz) + xt * (xy * yz - yy * xz)) / det ELSE 0 END AS pf_c FROM pf2),
    pf AS (SELECT well, pf_a, pf_b, pf_c, mt - pf_a * coalesce(mx, 0) - pf_b * coalesce(my, 0) - pf_c * coalesce(mz, 0) AS pf_d FROM pf3)"""
CONST = """con0 AS (SELECT well, max(row_idx) FILTER (TVT_input IS NOT NULL) AS last, count(*) AS n, count(TVT_input) AS seen, avg(GR) AS gr_mean, stddev_pop(GR) + 1e-9 AS gr_std FROM ev GROUP BY well),
    con AS (SELECT c.*, e.MD AS visible_md_max, e.TVT_input AS tvt_input_visible_last, e.X AS x_last, e.Y AS y_last, e.Z AS z_last, CAST(seen AS INTEGER) AS visible_n, CAST(seen AS DOUBLE) / greatest(n, 1) AS visible_ratio
        FROM con0 c LEFT JOIN ev e ON e.well = c.well AND e.row_idx = c.last)"""
add("gr_zscore", lambda s, d: features.feature_table(well_ev(s, d)).select(*ID, "GR_z", "gr_mean", "gr_std"), f"WITH {EV}, {CONST} SELECT well, row_idx, {R('(GR - gr_mean) / gr_std')} AS GR_z, {RS('gr_mean', 'gr_std')} FROM ev JOIN con USING (well)")
add("visible_anchor", lambda s, d: features.well_constants(well_ev(s, d)).select("well", "visible_md_max", "tvt_input_visible_last", "x_last", "y_last", "z_last", "visible_n", "visible_ratio"), f"WITH {EV}, {CONST} SELECT well, {RS('visible_md_max', 'tvt_input_visible_last', 'x_last', 'y_last', 'z_last', 'visible_ratio')}, visible_n FROM con")
add("visible_delta", lambda s, d: features.feature_table(well_ev(s, d)).select(*ID, "md_to_visible_end", "x_to_visible_end", "y_to_visible_end", "z_to_visible_end"), f"WITH {EV}, {CONST} SELECT well, row_idx, " + ", ".join(f"{R(f'{c.upper()} - {l}')} AS {c}_to_visible_end" for c, l in (("md", "visible_md_max"), ("x", "x_last"), ("y", "y_last"), ("z", "z_last"))) + " FROM ev JOIN con USING (well)")
add("plane_fit", lambda s, d: planefit.plane_fit(well_ev(s, d)), f"WITH {EV}, {PF} SELECT well, {RS('pf_a', 'pf_b', 'pf_c', 'pf_d')} FROM pf")
add("plane_fit_lstsq", lambda s, d: planefit.plane_fit_lstsq(well_ev(s, d)), f"WITH {EV}, {PF} SELECT well, {RS('pf_a', 'pf_b', 'pf_c', 'pf_d')} FROM pf")
add("plane_pred", lambda s, d: features.feature_table(well_ev(s, d)).select(*ID, "tvt_planefit_pred"), f"WITH {EV}, {PF} SELECT well, row_idx, {R('pf_a * X + pf_b * Y + pf_c * Z + pf_d')} AS tvt_planefit_pred FROM ev JOIN pf USING (well)")
_FEATURE_SQL = {"GR_z": "(GR - gr_mean) / gr_std", "tvt_planefit_pred": "pf_a * X + pf_b * Y + pf_c * Z + pf_d", "md_to_visible_end": "MD - visible_md_max", "x_to_visible_end": "X - x_last", "y_to_visible_end": "Y - y_last", "z_to_visible_end": "Z - z_last"}
_FEATURE_SQL |= {f"GR_roll_mean_{k}": f"avg(GR) {frame(k - 1)}" for k in sequence.ROLL_WINDOWS} | {f"GR_roll_std_{k}": f"coalesce(stddev_samp(GR) {frame(k - 1)}, 0)" for k in sequence.ROLL_WINDOWS} | {f"GR_diff_{k}": f"GR - lag(GR, {k}) {OVER}" for k in sequence.DIFF_LAGS}
add("feature_table", lambda s, d: features.feature_table(well_ev(s, d)), f"WITH {EV}, {PF}, {CONST}, {DERIV} SELECT well, row_idx, visible_n, {RS('TVT_input', 'TVT')}, " + ", ".join(f"{R(_FEATURE_SQL.get(f, f))} AS {f}" for f in features.FEATURES if f != "visible_n") + " FROM der3 JOIN con USING (well) JOIN pf USING (well)")

# Profiles.
RUNS = """rn0 AS (SELECT split, well, row_idx, TVT_input IS NOT NULL AS is_visible, CASE WHEN (TVT_input IS NOT NULL) <> lag(TVT_input IS NOT NULL) OVER (PARTITION BY split, well ORDER BY row_idx) THEN 1 ELSE 0 END AS edge FROM us),
    rn1 AS (SELECT *, sum(edge) OVER (PARTITION BY split, well ORDER BY row_idx) AS run FROM rn0),
    rn AS (SELECT split, well, is_visible, min(row_idx) AS "start", max(row_idx) AS "end" FROM rn1 GROUP BY split, well, is_visible, run),
    shp AS (SELECT split, well, count(*) FILTER (is_visible) AS n_visible_runs, count(*) FILTER (NOT is_visible) AS n_hidden_runs, coalesce(count(*) FILTER (NOT is_visible) = 1 AND max("end") FILTER (NOT is_visible) = max("end"), false) AS trailing_hidden_only FROM rn GROUP BY split, well)"""
STEP = """stp0 AS (SELECT split, well, MD - lag(MD) OVER (PARTITION BY split, well ORDER BY row_idx) AS step FROM us),
    mode0 AS (SELECT split, well, round_even(step, 0) AS v, count(*) AS c FROM stp0 WHERE step IS NOT NULL GROUP BY ALL),
    mode1 AS (SELECT split, well, v FROM mode0 QUALIFY row_number() OVER (PARTITION BY split, well ORDER BY c DESC, v) = 1),
    stp AS (SELECT s.split, s.well, any_value(m.v) AS MD_step_modal, min(step) AS MD_step_min, max(step) AS MD_step_max, count(DISTINCT round_even(step * 1000, 0) / 1000) AS MD_steps_unique_count FROM stp0 s LEFT JOIN mode1 m USING (split, well) GROUP BY s.split, s.well)"""
PROF = """prf AS (SELECT split, well, count(*) AS n_rows, count(TVT_input) AS n_visible, count(*) - count(TVT_input) AS n_hidden, count(TVT_input)::DOUBLE / count(*) AS visible_ratio, min(MD) AS MD_min, max(MD) AS MD_max, max(MD) - min(MD) AS MD_range,
        min(X) AS X_min, max(X) AS X_max, min(Y) AS Y_min, max(Y) AS Y_max, min(Z) AS Z_min, max(Z) AS Z_max, max(Z) - min(Z) AS Z_range, min(GR) AS GR_min, max(GR) AS GR_max, avg(GR) AS GR_mean, stddev_samp(GR) AS GR_std,
        coalesce(min(row_idx) FILTER (TVT_input IS NULL), -1) AS first_hidden_idx, min(MD) FILTER (TVT_input IS NULL) AS first_hidden_md, min(TVT) AS TVT_min, max(TVT) AS TVT_max, max(TVT) - min(TVT) AS TVT_range,
        CASE WHEN count(TVT) > 0 THEN coalesce(bool_and(coalesce(abs(TVT_input - TVT) <= 1e-3 + 1e-5 * abs(TVT), false)) FILTER (TVT_input IS NOT NULL), true) END AS TVT_input_matches_TVT_on_visible FROM us GROUP BY split, well)"""
TWPROF = """twp0 AS (SELECT split, well, TVT, GR, Geology, round_even((TVT - lag(TVT) OVER (PARTITION BY split, well ORDER BY TVT)) * 10, 0) AS step FROM ut),
    twm0 AS (SELECT split, well, step AS v, count(*) AS c FROM twp0 WHERE step IS NOT NULL GROUP BY ALL),
    twm AS (SELECT split, well, v FROM twm0 QUALIFY row_number() OVER (PARTITION BY split, well ORDER BY c DESC, v) = 1),
    twp AS (SELECT p.split, p.well, count(*) AS typewell_n_rows, min(TVT) AS typewell_TVT_min, max(TVT) AS typewell_TVT_max, avg(GR) AS typewell_GR_mean, stddev_samp(GR) AS typewell_GR_std, any_value(m.v) / 10 AS typewell_TVT_step_modal,
        count(DISTINCT Geology) AS typewell_geology_unique_count, count(Geology) AS typewell_geology_n_labeled FROM twp0 p LEFT JOIN twm m USING (split, well) GROUP BY p.split, p.well)"""
JOINED = "jp AS (SELECT *, CASE WHEN TVT_min IS NOT NULL THEN typewell_TVT_min <= TVT_min AND typewell_TVT_max >= TVT_max END AS typewell_covers_horizontal_tvt FROM prf JOIN stp USING (split, well) JOIN shp USING (split, well) JOIN twp USING (split, well))"
ALLPROF = f"WITH {USER}, {USER_TW}, {RUNS}, {STEP}, {PROF}, {TWPROF}, {JOINED}"
KEY = ["split", "well"]


def _profile(s, d, *cols):
    return profile.joined_profile(well_user(s, d), user_typewells(s, d), KEY).select(*KEY, *cols)


def profiled(name: str, doubles: list[str], others: list[str]) -> None:
    add(name, lambda s, d: _profile(s, d, *doubles, *others), f"{ALLPROF} SELECT split, well, {', '.join([*[f'{R(c)} AS {c}' for c in doubles], *others])} FROM jp")


profiled("well_counts", ["visible_ratio"], ["n_rows", "n_visible", "n_hidden"])
profiled("well_minmax", ["MD_min", "MD_max", "MD_range", "X_min", "X_max", "Y_min", "Y_max", "Z_min", "Z_max", "Z_range", "GR_min", "GR_max", "GR_mean", "GR_std", "TVT_min", "TVT_max", "TVT_range"], [])
profiled("step_stats", ["MD_step_min", "MD_step_max"], ["MD_steps_unique_count"])
profiled("modal_step", ["MD_step_modal", "typewell_TVT_step_modal"], [])
profiled("trailing_hidden", [], ["n_visible_runs", "n_hidden_runs", "trailing_hidden_only"])
profiled("first_hidden", ["first_hidden_md"], ["first_hidden_idx"])
profiled("tvt_match", [], ["TVT_input_matches_TVT_on_visible"])
profiled("typewell_stats", ["typewell_TVT_min", "typewell_TVT_max", "typewell_GR_mean", "typewell_GR_std"], ["typewell_n_rows"])
profiled("geology_counts", [], ["typewell_geology_unique_count", "typewell_geology_n_labeled"])
profiled("coverage", [], ["typewell_covers_horizontal_tvt"])
add("runs", lambda s, d: profile.runs(well_user(s, d).withColumn("TVT_input", F.when(F.col("row_idx") % 11 < 7, F.col("TVT"))), KEY), f"WITH {USER.replace(' us AS (', ' us9 AS (')}, us AS (SELECT * REPLACE (CASE WHEN row_idx % 11 < 7 THEN TVT END AS TVT_input) FROM us9), {RUNS} SELECT split, well, is_visible, \"start\", \"end\" FROM rn")
add("quantiles", lambda s, d: _profile(s, d, "n_rows", "visible_ratio", "GR_mean").groupBy("split").agg(*[q for c in ("n_rows", "visible_ratio", "GR_mean") for q in profile.quantiles(c, (0.25, 0.5, 0.75, 0.95))]), f"{ALLPROF} SELECT split, " + ", ".join(f"{R(f'quantile_cont({c}::DOUBLE, {p})')} AS {c}_p{round(p * 100)}" for c in ("n_rows", "visible_ratio", "GR_mean") for p in (0.25, 0.5, 0.75, 0.95)) + " FROM jp GROUP BY split")
add("freq_top5", lambda s, d: profile.frequencies(_profile(s, d, "n_rows"), F.col("n_rows"), 5, ["split"]).withColumn("rank", F.col("rank").cast("long")), f"{ALLPROF} SELECT split, n_rows AS value, count(*) AS count, row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, min(well)) AS rank FROM jp GROUP BY split, n_rows QUALIFY rank <= 5")
add("conditional_counts", lambda s, d: _profile(s, d, "n_hidden", "n_visible_runs", "trailing_hidden_only").groupBy("split").agg(F.count_if(F.col("n_hidden") > 0).alias("with_hidden"), F.count_if("trailing_hidden_only").alias("trailing"), F.count_if(F.col("n_visible_runs") > 1).alias("split_runs")), f"{ALLPROF} SELECT split, count(*) FILTER (n_hidden > 0) AS with_hidden, count(*) FILTER (trailing_hidden_only) AS trailing, count(*) FILTER (n_visible_runs > 1) AS split_runs FROM jp GROUP BY split")
_WHOLE = lambda c, p: f"CAST(trunc(quantile_cont({c}::DOUBLE, {p})) AS INTEGER)"
_PAIRS = lambda c, k: f"(SELECT split, list({{'value': v, 'count': c}} ORDER BY c DESC, w) AS l FROM (SELECT split, round_even({c} * {10**k}, 0) / {10**k} AS v, count(*) AS c, min(well) AS w FROM jp GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, min(well)) <= 5) GROUP BY split)"


def _summary(s, d):
    flat = profile.split_summary(_profile(s, d, "*"))
    return flat.select(*[F.to_json(c).alias(c) if isinstance(flat.schema[c].dataType, T.ArrayType) else F.col(c) for c in flat.columns])


_SUM = {"MD_step_max_max": R("max(MD_step_max)"), "MD_step_min_min": R("min(MD_step_min)"), "n_wells": "count(*)", "n_rows_min": "min(n_rows)", "n_rows_max": "max(n_rows)", "n_rows_p50": _WHOLE("n_rows", 0.5), "n_rows_p95": _WHOLE("n_rows", 0.95), "visible_ratio_min": R("min(visible_ratio)"), "visible_ratio_max": R("max(visible_ratio)")}
_SUM |= {f"visible_ratio_p{round(p * 100)}": R(f"quantile_cont(visible_ratio, {p})") for p in (0.25, 0.5, 0.75)} | {"wells_with_eval_zone": "count(*) FILTER (n_hidden > 0)", "wells_with_trailing_hidden_only": "count(*) FILTER (trailing_hidden_only)", "wells_with_visible_runs_gt_1": "count(*) FILTER (n_visible_runs > 1)", "wells_with_hidden_runs_gt_1": "count(*) FILTER (n_hidden_runs > 1)", "wells_zero_hidden": "count(*) FILTER (n_hidden = 0)"}
_SUM |= {"GR_mean_min": R("min(GR_mean)"), "GR_mean_max": R("max(GR_mean)"), "GR_mean_p50": R("quantile_cont(GR_mean, 0.5)"), "GR_std_p50": R("quantile_cont(GR_std, 0.5)"), "typewell_n_rows_min": "min(typewell_n_rows)", "typewell_n_rows_max": "max(typewell_n_rows)", "typewell_n_rows_p50": _WHOLE("typewell_n_rows", 0.5), "Z_range_p50": R("quantile_cont(Z_range, 0.5)"), "Z_range_p95": R("quantile_cont(Z_range, 0.95)")}
_SUM |= {"TVT_min_min": R("min(TVT_min)"), "TVT_max_max": R("max(TVT_max)"), "TVT_range_p50": R("quantile_cont(TVT_range, 0.5)"), "TVT_range_p95": R("quantile_cont(TVT_range, 0.95)"), "TVT_input_eq_TVT_on_visible_all_wells": "bool_and(TVT_input_matches_TVT_on_visible)", "typewell_covers_horizontal_tvt_count": "count(*) FILTER (typewell_covers_horizontal_tvt)"}
for _c in ("geology_n_labeled", "geology_unique_count"):
    _SUM |= {f"typewell_{_c}_p50": _WHOLE(f"typewell_{_c}", 0.5), f"typewell_{_c}_min": f"min(typewell_{_c})", f"typewell_{_c}_max": f"max(typewell_{_c})"}
add("split_summary", lambda s, d: _summary(s, d).drop("MD_step_modal_unique", "typewell_TVT_step_modal_unique"), f"{ALLPROF} SELECT split, {', '.join(f'{e} AS {n}' for n, e in _SUM.items())} FROM jp GROUP BY split")
add("split_frequencies", lambda s, d: profile.split_summary(_profile(s, d, "*")).select("split", F.explode("MD_step_modal_unique").alias("f")).select("split", F.col("f.value").alias("value"), F.col("f.count").alias("count")), f"{ALLPROF} SELECT split, round_even(MD_step_modal * 1000, 0) / 1000 AS value, count(*) AS count FROM jp GROUP BY ALL")

# Spatial neighbours.
FROM_POINTS = f"WITH {POINTS}, sc AS (SELECT CASE WHEN stddev_pop(x) < 1e-3 THEN 1 ELSE stddev_pop(x) END AS sx, CASE WHEN stddev_pop(y) < 1e-3 THEN 1 ELSE stddev_pop(y) END AS sy FROM pts)"


def _nn(k: int) -> str:
    return f"nn AS (SELECT q.wid AS qid, p.*, q.x AS qx, q.y AS qy, sqrt(((q.x - p.x) / sx) ** 2 + ((q.y - p.y) / sy) ** 2) AS dist, row_number() OVER (PARTITION BY q.wid ORDER BY sqrt(((q.x - p.x) / sx) ** 2 + ((q.y - p.y) / sy) ** 2), p.wid) AS rank FROM pts q, pts p, sc WHERE q.wid <> p.wid QUALIFY rank <= {k})"


_LEVEL = "CASE WHEN abs(det) > 1e-12 * sxx * syy * s THEN (sxx * (syy * s_{t} - sy * sy_{t}) - sxy * (sxy * s_{t} - sy_{t} * sx) + sx_{t} * (sxy * sy - syy * sx)) / det ELSE s_{t} / s END"
_PLANE = f"""{FROM_POINTS}, {_nn(10)}, w AS (SELECT *, 1 / (dist + 1e-3) AS w, x - qx AS dx, y - qy AS dy FROM nn),
    m AS (SELECT qid, min(dist) AS min_dist, sum(w) AS s, sum(w * dx) AS sx, sum(w * dy) AS sy, sum(w * dx * dx) AS sxx, sum(w * dx * dy) AS sxy, sum(w * dy * dy) AS syy, {", ".join(f"sum(w * {t}) AS s_{t}, sum(w * dx * {t}) AS sx_{t}, sum(w * dy * {t}) AS sy_{t}" for t in TOPS)} FROM w GROUP BY qid),
    d AS (SELECT *, sxx * (syy * s - sy * sy) - sxy * (sxy * s - sy * sx) + sx * (sxy * sy - syy * sx) AS det FROM m)"""
add("centroids", lambda s, d: knn.centroids(well_user(s, d).withColumnsRenamed({"TVT": "A", "MD": "B"}), ["A", "B"]), f"WITH {USER} SELECT well, {R('median(X)')} AS X, {R('median(Y)')} AS Y, {R('median(TVT)')} AS A, {R('median(MD)')} AS B FROM us WHERE X IS NOT NULL AND Y IS NOT NULL AND TVT IS NOT NULL AND MD IS NOT NULL GROUP BY well")
add("knn_topk", lambda s, d: knn.nearest(point_queries(s, d), points(s, d), 10, knn.scales(points(s, d))).select("qid", "wid", "dist", F.col("rank").cast("long").alias("rank")), f"{FROM_POINTS}, {_nn(10)} SELECT qid, wid, {R('dist')} AS dist, rank FROM nn")
add("knn_plane", lambda s, d: knn.plane_impute(point_queries(s, d), points(s, d), TOPS).drop("min_dist"), f"{_PLANE} SELECT qid, {', '.join(R(_LEVEL.format(t=t)) + f' AS {t}' for t in TOPS)} FROM d")
add("knn_mindist", lambda s, d: knn.plane_impute(point_queries(s, d), points(s, d), TOPS).select("qid", "min_dist"), f"{_PLANE} SELECT qid, {R('min_dist')} AS min_dist FROM d")
add("idw", lambda s, d: knn.idw_impute(point_queries(s, d), points(s, d), "top1"), f"{FROM_POINTS}, {_nn(20)} SELECT qid, {R('sum(top1 / (dist ** 2 + 1e-9)) / sum(1 / (dist ** 2 + 1e-9))')} AS top1 FROM nn GROUP BY qid")
add("thinned_rows", lambda s, d: knn.every_nth(well_user(s, d), 10).select(*ID), f"WITH {USER}, st AS (SELECT well, greatest(1, floor(count(*) / 10.0)) AS step FROM us GROUP BY well) SELECT well, row_idx FROM us JOIN st USING (well) WHERE row_idx % step = 0")

# Folds, errors, models.
PRED = f"WITH {EV}, {PF}, {CONST}, pred AS (SELECT e.*, pf_a * X + pf_b * Y + pf_c * Z + pf_d AS p, e.TVT_input IS NULL AS is_hidden FROM ev e JOIN pf USING (well))"


def _pred(s, d):
    return features.feature_table(well_ev(s, d)).select(*ID, "TVT", F.col("tvt_planefit_pred").alias("p"), F.col("TVT_input").isNull().alias("is_hidden"), "tvt_input_visible_last", "md_to_visible_end")


def _folds_sql(names: str, n: int = 5, seed: int = 42) -> str:
    """The shuffled order is NumPy's; DuckDB sees it as a list of positions for up to 1500 wells."""
    import numpy as np

    rows = []
    for size in (15, 150, 1500):
        order = list(range(size))
        np.random.RandomState(seed).shuffle(order)
        rows.append(f"SELECT {size} AS size, unnest({order}) AS pos, generate_subscripts({order}, 1) - 1 AS i")
    return f"ord AS ({' UNION ALL '.join(rows)}), nm AS (SELECT well, row_number() OVER (ORDER BY well) - 1 AS pos, count(*) OVER () AS size FROM (SELECT DISTINCT well FROM {names})), fm AS (SELECT well, CAST(i % {n} AS INTEGER) AS fold FROM nm JOIN ord USING (size, pos))"


add("fold_assign", lambda s, d: crossval.fold_map(well_user(s, d)), f"WITH {USER}, {_folds_sql('us')} SELECT well, fold FROM fm")
add("fold_split", lambda s, d: crossval.with_folds(well_user(s, d), crossval.fold_map(well_user(s, d))).groupBy("fold").agg(F.count("*").alias("rows"), F.count_distinct("well").alias("wells")), f"WITH {USER}, {_folds_sql('us')} SELECT fold, count(*) AS rows, count(DISTINCT well) AS wells FROM us JOIN fm USING (well) GROUP BY fold")
add("multi_seed_folds", lambda s, d: crossval.multi_seed(well_user(s, d), [42, 7]).groupBy("seed", "fold").agg(F.count("*").alias("wells")), f"WITH {USER}, a AS (SELECT *, 42::INTEGER AS seed FROM (WITH {_folds_sql('us')} SELECT * FROM fm)), b AS (SELECT *, 7::INTEGER AS seed FROM (WITH {_folds_sql('us', 5, 7)} SELECT * FROM fm)) SELECT seed, fold, count(*) AS wells FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
add("strat_folds", lambda s, d: crossval.stratified_folds(well_user(s, d).groupBy("well").agg(F.count("*").alias("n_rows")), "n_rows"), f"WITH {USER}, g AS (SELECT well, count(*) AS n_rows FROM us GROUP BY well), b AS (SELECT well, n_rows, CAST(ntile(5) OVER (ORDER BY n_rows, well) AS INTEGER) AS bin FROM g) SELECT well, bin, CAST((row_number() OVER (PARTITION BY bin ORDER BY n_rows, well) - 1) % 5 AS INTEGER) AS fold FROM b")
add("rmse_all", lambda s, d: _pred(s, d).agg(crossval.rmse("TVT", "p").alias("rmse")), f"{PRED} SELECT {R('sqrt(avg((TVT - p) ** 2))')} AS rmse FROM pred")
add("rmse_hidden", lambda s, d: _pred(s, d).agg(crossval.rmse("TVT", "p", F.col("is_hidden")).alias("rmse")), f"{PRED} SELECT {R('sqrt(avg((TVT - p) ** 2) FILTER (is_hidden))')} AS rmse FROM pred")
add("rmse_by_well", lambda s, d: _pred(s, d).groupBy("well").agg(crossval.rmse("TVT", "p").alias("rmse"), crossval.rmse("TVT", "p", F.col("is_hidden")).alias("rmse_hidden")), f"{PRED} SELECT well, {R('sqrt(avg((TVT - p) ** 2))')} AS rmse, {R('sqrt(avg((TVT - p) ** 2) FILTER (is_hidden))')} AS rmse_hidden FROM pred GROUP BY well")
add("rmse_by_fold", lambda s, d: crossval.with_folds(well_user(s, d).filter("split = 'train'").withColumn("p", F.avg("TVT_input").over(Window.partitionBy("well"))), crossval.fold_map(well_user(s, d))).groupBy("fold").agg(crossval.rmse("TVT", "p", F.col("TVT_input").isNull()).alias("rmse")), f"WITH {USER}, {_folds_sql('us')}, p AS (SELECT *, avg(TVT_input) OVER (PARTITION BY well) AS p FROM us WHERE split = 'train') SELECT fold, {R('sqrt(avg((TVT - p) ** 2) FILTER (TVT_input IS NULL))')} AS rmse FROM p JOIN fm USING (well) GROUP BY fold")
add("nunique_wells", lambda s, d: well_user(s, d).groupBy("split").agg(F.count_distinct("well").alias("wells")), f"WITH {USER} SELECT split, count(DISTINCT well) AS wells FROM us GROUP BY split")
add("target_encode", lambda s, d: crossval.target_encode(crossval.with_folds(well_user(s, d).filter("split = 'train'"), crossval.fold_map(well_user(s, d))).withColumn("cat", F.floor(F.col("X") / 10)), "cat", "TVT").groupBy("cat", "fold").agg(F.max("encoded").alias("encoded")), f"""WITH {USER}, {_folds_sql('us')}, r AS (SELECT floor(X / 10)::BIGINT AS cat, fold, TVT FROM us JOIN fm USING (well) WHERE split = 'train'), g AS (SELECT cat, fold, sum(TVT) AS s, count(TVT) AS n FROM r GROUP BY ALL), t AS (SELECT sum(TVT) AS s, count(TVT) AS n FROM r), f AS (SELECT fold, sum(TVT) AS s, count(TVT) AS n FROM r GROUP BY fold)
    SELECT cat, fold, {R('CASE WHEN sum(g.n) OVER (PARTITION BY cat) > g.n THEN (sum(g.s) OVER (PARTITION BY cat) - g.s) / (sum(g.n) OVER (PARTITION BY cat) - g.n) ELSE (t.s - f.s) / (t.n - f.n) END')} AS encoded FROM g JOIN f USING (fold), t""")


def _oof(s, d, **options):
    t = features.feature_table(well_user(s, d))
    train, test = t.filter("TVT IS NOT NULL"), t.filter("TVT IS NULL")
    return crossval.out_of_fold(train, features.FEATURES, "TVT", crossval.fold_map(train), test, **options)


add("oof_gbt", lambda s, d: _oof(s, d)[0].drop("fold"))
add("oof_gbt_residual", lambda s, d: _oof(s, d, residual_to="tvt_input_visible_last")[0].drop("fold"))
add("test_mean_pred", lambda s, d: _oof(s, d)[1])
add("adversarial_auc", lambda s, d: s.createDataFrame([(crossval.adversarial_auc(well_user(s, d).filter("split = 'train'"), well_user(s, d).filter("split = 'test'"), ["X", "Y", "Z"]),)], "auc double"))
add("pseudo_labels", lambda s, d: crossval.pseudo_labelled(well_user(s, d).filter("split = 'train'"), well_user(s, d).filter("split = 'test'").withColumn("tvt_pred", F.col("MD")), well_user(s, d).filter("split = 'test'"), "TVT").select(*ID, "TVT"), f"WITH {USER} SELECT well, row_idx, {R('CASE WHEN split = $$test$$ THEN MD ELSE TVT END')} AS TVT FROM us".replace("$$", "'"))

# Alignment with a typewell.
SEG = "sg AS (SELECT TVT AS t0, GR AS g0, lead(TVT) OVER (ORDER BY TVT) AS t1, lead(GR) OVER (ORDER BY TVT) AS g1 FROM tw), lim AS (SELECT min(TVT) AS lo, max(TVT) AS hi FROM tw)"


def interp(rows: str, at: str, out: str = "tw_gr") -> str:
    return f"SELECT r.*, CASE WHEN t1 IS NULL THEN g0 ELSE g0 + (g1 - g0) * (greatest(least({at}, hi), lo) - t0) / (t1 - t0) END AS {out} FROM {rows} r, lim ASOF LEFT JOIN sg ON greatest(least({at}, hi), lo) >= t0"


def interp2(rows: str, at: str, cols: str, out: str = "tw_gr") -> str:
    return f"SELECT {cols}, CASE WHEN t1 IS NULL THEN g0 ELSE g0 + (g1 - g0) * (d_ - t0) / (t1 - t0) END AS {out} FROM (SELECT r.*, greatest(least({at}, (SELECT hi FROM lim)), (SELECT lo FROM lim)) AS d_ FROM {rows} r) q ASOF LEFT JOIN sg ON q.d_ >= sg.t0"


HALF = 500.0  # moves the wells' depths into the shared typewell's range
TWS = f"WITH {EV}, {TW}, {SEG}, sh AS (SELECT * REPLACE (TVT - {HALF} AS TVT, TVT_input - {HALF} AS TVT_input) FROM ev)"


def _shifted(s, d):
    return well_ev(s, d).withColumns({"TVT": F.col("TVT") - HALF, "TVT_input": F.col("TVT_input") - HALF})


def _anchored(s, d):
    last = _shifted(s, d).groupBy("well").agg(F.max_by("TVT_input", F.when(F.col("TVT_input").isNotNull(), F.col("row_idx"))).alias("anchor"))
    return _shifted(s, d).join(last, "well")


ANCHORED = "an AS (SELECT sh.*, anchor FROM sh JOIN (SELECT well, arg_max(TVT_input, row_idx) FILTER (TVT_input IS NOT NULL) AS anchor FROM sh GROUP BY well) USING (well))"
add("tw_interp", lambda s, d: align.interpolate(well_ev(s, d).select(*ID, "TVT"), "TVT", typewell(s, d)).select(*ID, "tw_gr"), f"{TWS} SELECT well, row_idx, {R('tw_gr')} AS tw_gr FROM ({interp2('ev', 'TVT', 'well, row_idx')})")
add("tw_interp_keyed", lambda s, d: align.interpolate(well_user(s, d).select(*KEY, "row_idx", "TVT_input"), "TVT_input", user_typewells(s, d), key=KEY).filter("TVT_input is not null").select(*KEY, "row_idx", "tw_gr"), f"""WITH {USER}, {USER_TW}, sg AS (SELECT split, well, TVT AS t0, GR AS g0, lead(TVT) OVER w AS t1, lead(GR) OVER w AS g1 FROM ut WINDOW w AS (PARTITION BY split, well ORDER BY TVT)), lim AS (SELECT split, well, min(TVT) AS lo, max(TVT) AS hi FROM ut GROUP BY ALL),
    q AS (SELECT us.split, us.well, row_idx, greatest(least(TVT_input, hi), lo) AS x FROM us JOIN lim USING (split, well) WHERE TVT_input IS NOT NULL) SELECT q.split, q.well, row_idx, {R('CASE WHEN t1 IS NULL THEN g0 ELSE g0 + (g1 - g0) * (x - t0) / (t1 - t0) END')} AS tw_gr FROM q ASOF LEFT JOIN sg ON q.split = sg.split AND q.well = sg.well AND q.x >= sg.t0""")
_OFF = align.OFFSETS["anchor"]
add("tw_diff", lambda s, d: align.offset_bank(_anchored(s, d), "anchor", typewell(s, d)), f"{TWS}, {ANCHORED}, sp AS (SELECT well, row_idx, GR, anchor, unnest({_OFF}) AS o FROM an), i AS ({interp2('sp', 'anchor + o', 'well, row_idx, GR, o')}) SELECT well, row_idx, " + ", ".join(f"{R(f'max(GR - tw_gr) FILTER (o = {o})')} AS tw_diff_{'m' if o < 0 else 'p'}{abs(o)}" for o in _OFF) + " FROM i GROUP BY well, row_idx")
_FIT = f"{TWS}, i AS ({interp2('(SELECT * FROM sh WHERE TVT_input IS NOT NULL)', 'TVT_input', 'well, GR')})"
add("affine_cal", lambda s, d: align.affine_calibration(align.interpolate(_shifted(s, d).filter(scalar.visible()), "TVT_input", typewell(s, d))), f"{_FIT}, g AS (SELECT well, count(GR) AS n, stddev_pop(tw_gr) FILTER (GR IS NOT NULL) AS sd, regr_slope(GR, tw_gr) AS sl, regr_intercept(GR, tw_gr) AS ic, avg(GR) - avg(tw_gr) AS sh FROM i GROUP BY well) SELECT well, {R('CASE WHEN n < 20 OR sd IS NULL OR sd < 1e-6 THEN 1 ELSE sl END')} AS a_cal, {R('CASE WHEN n = 0 THEN 0 WHEN n < 20 OR sd IS NULL OR sd < 1e-6 THEN coalesce(sh, 0) ELSE ic END')} AS b_cal FROM g")
add("nearest_gr", lambda s, d: align.nearest_value(_anchored(s, d).filter(scalar.hidden()), "anchor", typewell(s, d).withColumn("GR", F.col("GR") % 97)).select(*ID, "matched_tvt"), f"{TWS}, {ANCHORED}, g AS (SELECT TVT, GR % 97 AS GR FROM tw) SELECT well, row_idx, {R('arg_min(g.TVT, (abs(an.GR - g.GR), g.TVT))')} AS matched_tvt FROM an JOIN g ON g.TVT BETWEEN anchor - 40 AND anchor + 40 WHERE an.GR IS NOT NULL AND an.TVT_input IS NULL GROUP BY well, row_idx")
add("match_shift", lambda s, d: align.match_shift(align.nearest_value(_anchored(s, d).filter(scalar.hidden()), "anchor", typewell(s, d).withColumn("GR", F.col("GR") % 97))), f"{TWS}, {ANCHORED}, g AS (SELECT TVT, GR % 97 AS GR FROM tw), m AS (SELECT well, arg_min(g.TVT, (abs(an.GR - g.GR), g.TVT)) - any_value(anchor) AS shift FROM an JOIN g ON g.TVT BETWEEN anchor - 40 AND anchor + 40 WHERE an.GR IS NOT NULL AND an.TVT_input IS NULL GROUP BY well, row_idx) SELECT well, {R('median(shift)')} AS ncc_med_shift, {R('avg(shift)')} AS ncc_mean_shift FROM m GROUP BY well")
_EASE = f"""{TWS}, {ANCHORED}, h AS (SELECT *, min(row_idx) OVER (PARTITION BY well) AS a, count(*) OVER (PARTITION BY well) AS n FROM an WHERE TVT_input IS NULL), f AS (SELECT *, (row_idx - a)::DOUBLE / greatest(n - 1, 1) AS fr FROM h),
    sp AS (SELECT well, GR, anchor, 3 * fr ** 2 - 2 * fr ** 3 AS ease, unnest({align.ENDPOINTS}) AS endpoint FROM f), i AS ({interp2('sp', 'anchor + endpoint * ease', 'well, GR, endpoint')}), pa AS (SELECT well, CAST(endpoint AS INTEGER) AS endpoint, avg(abs(GR - tw_gr)) AS path_abs FROM i GROUP BY well, endpoint)"""
add("ease_path", lambda s, d: align.ease_paths(_anchored(s, d).filter(scalar.hidden()), "anchor", typewell(s, d)), f"{_EASE} SELECT well, endpoint, {R('path_abs')} AS path_abs FROM pa")
add("best_endpoint", lambda s, d: align.best_endpoint(align.ease_paths(_anchored(s, d).filter(scalar.hidden()), "anchor", typewell(s, d)), tau=50.0), f"{_EASE}, o AS (SELECT well, list(endpoint ORDER BY path_abs, endpoint) AS e, list(path_abs ORDER BY path_abs, endpoint) AS p, sum(exp(-path_abs / 50) * endpoint) / sum(exp(-path_abs / 50)) AS soft FROM pa GROUP BY well) SELECT well, e[1] AS best_endpoint, {R('p[2] - p[1]')} AS gap, {R('soft')} AS soft_endpoint FROM o")
add("boundary_dist", lambda s, d: align.boundary_distance(_shifted(s, d).select(*ID, "TVT"), "TVT", typewell(s, d)).select(*ID, "boundary_dist"), f"{TWS}, b AS (SELECT TVT AS x FROM (SELECT TVT, Geology, lag(Geology) OVER (ORDER BY TVT) AS g FROM tw) WHERE Geology <> g), l AS (SELECT sh.well, sh.row_idx, sh.TVT, b.x AS lx FROM sh ASOF LEFT JOIN b ON sh.TVT >= b.x), r AS (SELECT l.*, b.x AS rx FROM l ASOF LEFT JOIN b ON l.TVT <= b.x) SELECT well, row_idx, {R('least(abs(TVT - lx), abs(rx - TVT))')} AS boundary_dist FROM r")
add("tw_resample", lambda s, d: align.resample(typewell(s, d)).select("TVT", "GR"), f"WITH {TW}, {SEG}, g AS (SELECT unnest(generate_series((SELECT ceil(lo)::BIGINT FROM lim), (SELECT floor(hi)::BIGINT FROM lim)))::DOUBLE AS TVT) SELECT {R('TVT')} AS TVT, {R('tw_gr')} AS GR FROM ({interp2('g', 'TVT', 'TVT')})")
_XC = "row_number() OVER (PARTITION BY well, row_idx ORDER BY round(c, 9) DESC, abs(o), o DESC)"
add("xcorr", lambda s, d: align.shifted_correlation(_anchored(s, d), "TVT", typewell(s, d).withColumn("GR", F.col("GR") % 97), align.SEARCH), f"""WITH {EV}, tw AS (SELECT 10000 + CAST(0.5 AS DOUBLE) * p_partkey AS TVT, CAST(p_retailprice AS DOUBLE) % 97 AS GR, p_brand AS Geology FROM part), {SEG}, sh AS (SELECT * REPLACE (TVT - {HALF} AS TVT) FROM ev),
    sp AS (SELECT well, row_idx, GR, TVT, CAST(unnest(range(-120, 121)) AS INTEGER) AS o FROM sh), i AS ({interp2('sp', 'TVT + o', 'well, row_idx, GR, o')}),
    w AS (SELECT *, CASE WHEN var_pop(CASE WHEN GR IS NOT NULL THEN tw_gr END) OVER f > 1e-9 AND var_pop(CASE WHEN tw_gr IS NOT NULL THEN GR END) OVER f > 1e-9 THEN corr(GR, tw_gr) OVER f END AS c FROM i WINDOW f AS (PARTITION BY well, o ORDER BY row_idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING))
    SELECT well, row_idx, {R('round(c, 9)')} AS xcorr_best_corr, o AS xcorr_tvt_delta, {R('abs(GR - tw_gr)')} AS xcorr_best_absdiff FROM w WHERE c IS NOT NULL QUALIFY {_XC} = 1""")

# Physics and post-processing.
add("residual_target", lambda s, d: features.feature_table(well_ev(s, d)).select(*ID, post.residual().alias("residual")), f"WITH {EV}, {CONST} SELECT well, row_idx, {R('TVT - tvt_input_visible_last')} AS residual FROM ev JOIN con USING (well)")
add("wls_bias", lambda s, d: post.well_bias(well_ev(s, d), "Y", decay=0.02), f"WITH {EV}, v AS (SELECT well, TVT_input + Z - Y AS v, exp(CAST(0.02 AS DOUBLE) * (row_number() OVER (PARTITION BY well ORDER BY row_idx) - count(*) OVER (PARTITION BY well))) AS w FROM ev WHERE TVT_input IS NOT NULL) SELECT well, {R('sum(w * v) / sum(w)')} AS b_well FROM v GROUP BY well")
add("closed_form", lambda s, d: well_ev(s, d).join(post.well_bias(well_ev(s, d), "Y"), "well").select(*ID, post.closed_form("Y").alias("tvt_formula")), f"WITH {EV}, b AS (SELECT well, avg(TVT_input + Z - Y) AS b_well FROM ev WHERE TVT_input IS NOT NULL GROUP BY well) SELECT well, row_idx, {R('-Z + Y + b_well')} AS tvt_formula FROM ev JOIN b USING (well)")
add("zvel_path", lambda s, d: post.z_velocity_path(well_ev(s, d)).select(*ID, "z_vel_delta"), f"WITH {EV}, st AS (SELECT *, Z - lag(Z) {OVER} AS dz, MD - lag(MD) {OVER} AS dm, TVT_input - lag(TVT_input) {OVER} AS dt FROM ev), f AS (SELECT well, coalesce(regr_slope(dt / dm, dz / dm), 0) AS beta, coalesce(regr_intercept(dt / dm, dz / dm), 0) AS c FROM st WHERE TVT_input IS NOT NULL GROUP BY well), m AS (SELECT st.*, CASE WHEN TVT_input IS NULL THEN (beta * dz / dm + c) * dm END AS mv FROM st JOIN f USING (well)), p AS (SELECT *, coalesce(sum(mv) {OVER}, 0) AS moved FROM m) SELECT well, row_idx, {R('moved')} AS z_vel_delta FROM p WHERE TVT_input IS NULL")
_GRID = "unnest([0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]::DOUBLE[])"
add("fade_in_grid", lambda s, d: post.fade_in_grid(_pred(s, d).filter("is_hidden").withColumns({"delta": F.col("p") - F.col("tvt_input_visible_last"), "error": F.col("TVT") - F.col("tvt_input_visible_last"), "md_since": F.col("md_to_visible_end")}), "delta", "error"), f"""{PRED}, r AS (SELECT p - tvt_input_visible_last AS delta, TVT - tvt_input_visible_last AS err, greatest(pred.MD - visible_md_max, 0) AS since FROM pred JOIN con USING (well) WHERE is_hidden), t AS (SELECT unnest([NULL, 25, 50, 100, 200]::DOUBLE[]) AS tau), g AS (SELECT {_GRID} AS alpha, tau FROM t)
    SELECT {R('alpha')} AS alpha, {R('tau')} AS tau, {R('sqrt(avg((err - alpha * delta * CASE WHEN tau IS NULL THEN 1 ELSE 1 - exp(-since / tau) END) ** 2))')} AS rmse FROM g, r GROUP BY alpha, tau""")
add("fade_in", lambda s, d: _pred(s, d).select(*ID, post.fade_in(F.col("p") - F.col("tvt_input_visible_last"), "md_to_visible_end", 0.9, 50.0).alias("faded")), f"{PRED} SELECT well, row_idx, {R('0.9::DOUBLE * (p - tvt_input_visible_last) * (1 - exp(-greatest(pred.MD - visible_md_max, 0) / 50.0::DOUBLE))')} AS faded FROM pred JOIN con USING (well)")
add("snap_clip", lambda s, d: align.boundary_distance(_shifted(s, d).select(*ID, "TVT"), "TVT", typewell(s, d), nearest="b").withColumns({"lo": F.lit(10100.0), "hi": F.lit(10400.0)}).select(*ID, post.clip_to_range("TVT", "lo", "hi").alias("clipped"), post.snap_to("TVT", "b", "boundary_dist", 0.25).alias("snapped")), f"{TWS}, b AS (SELECT TVT AS x FROM (SELECT TVT, Geology, lag(Geology) OVER (ORDER BY TVT) AS g FROM tw) WHERE Geology <> g), l AS (SELECT sh.well, sh.row_idx, sh.TVT, b.x AS lx FROM sh ASOF LEFT JOIN b ON sh.TVT >= b.x), r AS (SELECT l.*, b.x AS rx FROM l ASOF LEFT JOIN b ON l.TVT <= b.x) SELECT well, row_idx, {R('greatest(least(TVT, 10500), 10000)')} AS clipped, {R('CASE WHEN least(abs(TVT - lx), abs(rx - TVT)) <= 0.25 THEN CASE WHEN rx IS NULL OR TVT - lx <= rx - TVT THEN lx ELSE rx END ELSE TVT END')} AS snapped FROM r")
_SG = post.savgol_weights()
add("savgol", lambda s, d: post.savgol(well_user(s, d), "Z").select(*ID, "smooth"), f"WITH {USER}, c AS (SELECT [{', '.join('[' + ', '.join(repr(float(v)) for v in r) + ']' for r in _SG)}]::DOUBLE[][] AS m), l AS (SELECT well, list(Z ORDER BY row_idx) AS z, count(*) AS n FROM us GROUP BY well), q AS (SELECT us.well, row_idx, l.z, n, greatest(least(row_idx - 8, n - 17), 0) AS a FROM us JOIN l USING (well)) SELECT well, row_idx, {R('list_dot_product(z[a + 1:a + 17], m[row_idx - a + 1])')} AS smooth FROM q, c")
add("trust_blend", lambda s, d: _pred(s, d).join(features.well_constants(well_ev(s, d)).select("well", "visible_n"), "well").select(*ID, post.trust_blend("visible_n", "p", "TVT").alias("blend")), f"{PRED} SELECT well, row_idx, {R('(1 - least(greatest(visible_n / 200.0::DOUBLE, 0), 0.6)) * p + least(greatest(visible_n / 200.0::DOUBLE, 0), 0.6) * TVT')} AS blend FROM pred JOIN con USING (well)")

# Group statistics and masks.
add("group_stats", lambda s, d: statistics.group_stats(well_user(s, d), "GR"), f"WITH {USER}, m AS (SELECT well, GR, avg(GR) OVER (PARTITION BY well) AS a FROM us WHERE GR IS NOT NULL) SELECT well, {R('avg(GR)')} AS mean, {R('stddev_samp(GR)')} AS std, {R('min(GR)')} AS min, {R('max(GR)')} AS max, {R('median(GR)')} AS median, {R('avg((GR - a) ** 3) / sqrt(avg((GR - a) ** 2)) ** 3')} AS skew, {R('avg((GR - a) ** 4) / avg((GR - a) ** 2) ** 2 - 3')} AS kurt, count(DISTINCT GR) AS nunique FROM m GROUP BY well")
add("group_relative", lambda s, d: well_user(s, d).join(statistics.group_stats(well_user(s, d), "GR").select("well", "mean"), "well").select(*ID, *[c.alias(n) for n, c in statistics.relative_to_group("GR").items()]), f"WITH {USER}, m AS (SELECT *, avg(GR) OVER (PARTITION BY well) AS a FROM us) SELECT well, row_idx, {R('GR - a')} AS GR_diff_mean, {R('GR / a')} AS GR_ratio_mean FROM m")
add("detrend", lambda s, d: statistics.detrend(well_ev(s, d)).select(*ID, "detrended"), f"WITH {EV}, f AS (SELECT well, regr_slope(GR, MD) AS sl FROM ev GROUP BY well) SELECT well, row_idx, {R('GR - sl * MD')} AS detrended FROM ev JOIN f USING (well)")
add("interactions", lambda s, d: windows(well_ev(s, d), statistics.interactions()), f"WITH {EV} SELECT well, row_idx, {R('GR * MD')} AS GR_x_MD, {R('X ** 2')} AS X_sq, {R('GR / (MD + 1e-6)')} AS GR_per_MD, {R('X * Y')} AS X_x_Y FROM ev")
add("prefix_stats", lambda s, d: statistics.prefix_stats(well_ev(s, d)), f"WITH {EV} SELECT well, count(*) AS prefix_length, {R('regr_slope(TVT_input, MD)')} AS prefix_slope, {R('stddev_pop(TVT_input) * sqrt(greatest(0, 1 - corr(TVT_input, MD) ** 2))')} AS prefix_rmse FROM ev WHERE TVT_input IS NOT NULL GROUP BY well")
add("positions", lambda s, d: well_ev(s, d).join(well_ev(s, d).groupBy("well").agg(*sequence.anchor_aggregates()), "well").select(*ID, *[c.alias(n) for n, c in statistics.positions().items()]), f"WITH {EV}, {CONST} SELECT well, row_idx, {R('MD - visible_md_max')} AS md_since, {R('(row_idx - seen + 1)::DOUBLE / greatest(n - seen, 1)')} AS frac, {R('X - x_last')} AS dx, {R('Y - y_last')} AS dy, {R('Z - z_last')} AS dz FROM ev JOIN con USING (well)")
add("tail_mask", lambda s, d: statistics.tail_mask(well_user(s, d), 0.6, value="MD", out="masked").select(*ID, "masked"), f"WITH {USER}, c AS (SELECT well, count(*) AS n FROM us GROUP BY well) SELECT well, row_idx, {R('CASE WHEN row_idx < floor(n * (1 - 0.6::DOUBLE)) THEN MD END')} AS masked FROM us JOIN c USING (well)")
add("random_tail_mask", lambda s, d: statistics.tail_mask(well_user(s, d), statistics.random_ratio(), value="MD", out="masked").groupBy("well").agg(F.count("masked").alias("kept"), F.count("*").alias("rows")), f"WITH {USER}, c AS (SELECT well, count(*) AS n, 0.4::DOUBLE + {0.85 - 0.4!r}::DOUBLE * CAST('0x' || substr(md5(well || '-42'), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS ratio FROM us GROUP BY well) SELECT well, count(*) FILTER (row_idx < floor(n * (1 - ratio)) AND MD IS NOT NULL) AS kept, count(*) AS rows FROM us JOIN c USING (well) GROUP BY well")
add("finite_rate", lambda s, d: statistics.finite_rates(features.feature_table(well_ev(s, d)), ["GR", "GR_diff_20", "dX", "d2Z", "TVT_input"]), f"WITH {EV}, {DERIV}, x AS (SELECT *, GR - lag(GR, 20) {OVER} AS GR_diff_20 FROM der3) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {R(f'avg(({c} IS NOT NULL)::INTEGER)')} AS rate FROM x" for c in ("GR", "GR_diff_20", "dX", "d2Z", "TVT_input")) + ")")
add("gr_quantiles", lambda s, d: statistics.hidden_quantiles(well_ev(s, d)), f"WITH {EV} SELECT well, " + ", ".join(f"{R(f'quantile_cont(GR, {p})')} AS GR_q{round(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM ev WHERE TVT_input IS NULL GROUP BY well")

# Ensembles.
MODELS = "long AS (SELECT well, row_idx, 'a' AS model, MD AS pred, 1.0::DOUBLE AS weight FROM ev UNION ALL SELECT well, row_idx, 'b', X, 2.0 FROM ev UNION ALL SELECT well, row_idx, 'c', Y, 1.5 FROM ev)"


def _long(s, d):
    e = well_ev(s, d)
    part = lambda m, c, w: e.select(*ID, F.lit(m).alias("model"), F.col(c).alias("pred"), F.lit(w).alias("weight"))
    return part("a", "MD", 1.0).union(part("b", "X", 2.0)).union(part("c", "Y", 1.5))


add("median_ensemble", lambda s, d: blend.median_ensemble(_long(s, d)), f"WITH {EV}, {MODELS} SELECT well, row_idx, {R('median(pred)')} AS pred FROM long GROUP BY well, row_idx")
add("mean_ensemble", lambda s, d: blend.mean_ensemble(_long(s, d)), f"WITH {EV}, {MODELS} SELECT well, row_idx, {R('avg(pred)')} AS pred FROM long GROUP BY well, row_idx")
add("weighted_median", lambda s, d: blend.weighted_median(_long(s, d)), f"WITH {EV}, {MODELS}, c AS (SELECT *, sum(weight) OVER (PARTITION BY well, row_idx ORDER BY pred, model) AS cw, sum(weight) OVER (PARTITION BY well, row_idx) AS tw FROM long) SELECT well, row_idx, {R('min(pred)')} AS pred FROM c WHERE 2 * cw >= tw GROUP BY well, row_idx")


def _weights(s, d, run):
    wide = _pred(s, d).withColumns({"m1": F.col("p"), "m2": F.col("tvt_input_visible_last"), "m3": F.col("p") + F.col("md_to_visible_end") / 100})
    return run(wide, ["m1", "m2", "m3"], "TVT")


_SUMS = f"""{PRED}, mm AS (SELECT p AS m1, tvt_input_visible_last AS m2, p + (pred.MD - visible_md_max) / 100 AS m3, TVT AS y FROM pred JOIN con USING (well) WHERE p IS NOT NULL AND tvt_input_visible_last IS NOT NULL AND visible_md_max IS NOT NULL AND TVT IS NOT NULL),
    g AS (SELECT count(*) AS n, sum(y * y) AS yy, {', '.join(f'sum(m{i} * m{j}) AS a{i}{j}' for i in (1, 2, 3) for j in range(i, 4))}, {', '.join(f'sum(m{i} * y) AS b{i}' for i in (1, 2, 3))} FROM mm)"""
_RIDGE = f"""{_SUMS}, r AS (SELECT * REPLACE (a11 + 1 AS a11, a22 + 1 AS a22, a33 + 1 AS a33) FROM g),
    sets AS (SELECT b1 / a11 AS w1, 0::DOUBLE AS w2, 0::DOUBLE AS w3 FROM r UNION ALL SELECT 0, b2 / a22, 0 FROM r UNION ALL SELECT 0, 0, b3 / a33 FROM r
        UNION ALL SELECT (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12), (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12), 0 FROM r UNION ALL SELECT (b1 * a33 - b3 * a13) / (a11 * a33 - a13 * a13), 0, (b3 * a11 - b1 * a13) / (a11 * a33 - a13 * a13) FROM r
        UNION ALL SELECT 0, (b2 * a33 - b3 * a23) / (a22 * a33 - a23 * a23), (b3 * a22 - b2 * a23) / (a22 * a33 - a23 * a23) FROM r
        UNION ALL SELECT (b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3)) / det, (a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13)) / det, (a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13)) / det
            FROM (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det FROM r)),
    st AS (SELECT s.* FROM sets s, r WHERE w1 >= 0 AND w2 >= 0 AND w3 >= 0 ORDER BY a11 * w1 * w1 + a22 * w2 * w2 + a33 * w3 * w3 + 2 * (a12 * w1 * w2 + a13 * w1 * w3 + a23 * w2 * w3) - 2 * (b1 * w1 + b2 * w2 + b3 * w3) LIMIT 1)"""
_ERROR = lambda w: f"sqrt(greatest(0, a11 * {w}1 * {w}1 + a22 * {w}2 * {w}2 + a33 * {w}3 * {w}3 + 2 * (a12 * {w}1 * {w}2 + a13 * {w}1 * {w}3 + a23 * {w}2 * {w}3) - 2 * (b1 * {w}1 + b2 * {w}2 + b3 * {w}3) + yy) / n)"
# Two of the three models nearly agree, so weights are sure to four places only.
add("nnls_stack", lambda s, d: s.createDataFrame(sorted(_weights(s, d, blend.stack).items()), "model string, weight double").withColumn("weight", F.round(F.col("weight") + 3.7e-7, 4)), f"{_RIDGE} " + " UNION ALL ".join(f"SELECT 'm{i}' AS model, round(w{i} + 3.7e-7, 4) AS weight FROM st" for i in (1, 2, 3)))
_MOVES = " UNION ALL ".join(f"SELECT {n} AS move, {', '.join(f'{0.05 if k == i else -0.05 if k == j else 0}::DOUBLE AS d{k}' for k in (1, 2, 3))}, {j} AS giver" for n, (i, j) in enumerate((i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i != j))
add("hill_climb", lambda s, d: s.createDataFrame(sorted(_weights(s, d, blend.hill_climb).items()), "model string, weight double"), f"""{_SUMS.replace('WITH ', 'WITH RECURSIVE ', 1)}, mv AS ({_MOVES}), one AS (SELECT 1::DOUBLE AS w1, 0::DOUBLE AS w2, 0::DOUBLE AS w3 UNION ALL SELECT 0, 1, 0 UNION ALL SELECT 0, 0, 1),
    first_ AS (SELECT w1, w2, w3, {_ERROR('w')} AS e FROM one, g QUALIFY row_number() OVER (ORDER BY e, w1 DESC, w2 DESC) = 1),
    hc AS (SELECT 0 AS turn, w1, w2, w3, e FROM first_ UNION ALL
        SELECT turn + 1, v1, v2, v3, {_ERROR('v')} AS e2 FROM (SELECT hc.*, move, w1 + d1 AS v1, w2 + d2 AS v2, w3 + d3 AS v3 FROM hc, mv WHERE turn < 500 AND CASE giver WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END >= 0.05 - 1e-12), g WHERE {_ERROR('v')} < e - 1e-12 QUALIFY row_number() OVER (ORDER BY e2, move) = 1),
    top AS (SELECT * FROM hc ORDER BY turn DESC LIMIT 1) """ + " UNION ALL ".join(f"SELECT 'm{i}' AS model, {R(f'round(w{i}, 10)')} AS weight FROM top" for i in (1, 2, 3)))
add("keep_best", lambda s, d: s.createDataFrame([(_weights(s, d, blend.keep_best)[0],)], "kept string"), f"{_RIDGE}, m AS (SELECT 1 / 3.0::DOUBLE AS m1, 1 / 3.0::DOUBLE AS m2, 1 / 3.0::DOUBLE AS m3) SELECT CASE WHEN {_ERROR('w')} < {_ERROR('m.m')} THEN 'stack' ELSE 'mean' END AS kept FROM st, g, m")

# Sequential operators; tests compare those without SQL with plain loops.


def _own_typewells(s, d):
    """The shared typewell for every well."""
    names = well_ev(s, d).select("well").distinct()
    return paths.typewell_of(typewell(s, d).select("TVT", (F.col("GR") % 97).alias("GR")), names)


add("beam_path", lambda s, d: paths.beam_features(_shifted(s, d), _own_typewells(s, d)))
add("particle_path", lambda s, d: paths.particle_features(_shifted(s, d), _own_typewells(s, d)))
add("particle_path_s", lambda s, d: paths.particle_features(_shifted(s, d), _own_typewells(s, d), on="s"))


def _ncc(half: int) -> str:
    """Every hidden window against every third visible one, as lists."""
    win = 2 * half + 1
    return f"""h{half} AS (SELECT well, i, list_concat(list_concat(list_resize(CAST([] AS DOUBLE[]), {half}, h[1]), h), list_resize(CAST([] AS DOUBLE[]), {half}, h[len(h)]))[i + 1:i + {win}] AS w FROM (SELECT well, h, unnest(range(len(h))) AS i FROM logs)),
    s{half} AS (SELECT well, s, v[s + 1:s + {win}] AS w, t[s + {half + 1}] AS tv FROM (SELECT well, v, t, unnest(range(0, len(v) - {win - 1}, 3)) AS s FROM logs)),
    c{half} AS (SELECT a.well, a.i, arg_min(b.tv, (-round(c, 9), b.s)) AS tv, max(round(c, 9)) AS score FROM (SELECT well, i, w, list_avg(w) AS m, list_stddev_pop(w) + 1e-6 AS d FROM h{half}) a JOIN (SELECT well, s, w, tv, list_avg(w) AS m, list_stddev_pop(w) + 1e-6 AS d FROM s{half}) b USING (well), LATERAL (SELECT (list_dot_product(a.w, b.w) / {win} - a.m * b.m) / (a.d * b.d) AS c) GROUP BY a.well, a.i)"""


_NCC = f"""WITH {EV}, fill AS (SELECT *, coalesce(GR, avg(GR) OVER (PARTITION BY well, TVT_input IS NULL)) AS g FROM ev),
    logs AS (SELECT well, list(g ORDER BY row_idx) FILTER (TVT_input IS NOT NULL) AS v, list(TVT_input ORDER BY row_idx) FILTER (TVT_input IS NOT NULL) AS t, list(g ORDER BY row_idx) FILTER (TVT_input IS NULL) AS h, list(row_idx ORDER BY row_idx) FILTER (TVT_input IS NULL) AS r, arg_max(TVT_input, row_idx) FILTER (TVT_input IS NOT NULL) AS last FROM fill GROUP BY well),
    hid AS (SELECT well, last, unnest(r) AS row_idx, generate_subscripts(r, 1) - 1 AS i FROM logs), {', '.join(_ncc(x) for x in (8, 15, 25))}
    SELECT hid.well, hid.row_idx, {', '.join(f"{R(f'c{x}.tv - last')} AS sc{x}_d, {R(f'c{x}.score')} AS sc{x}_score" for x in (8, 15, 25))} FROM hid {' '.join(f'LEFT JOIN c{x} ON c{x}.well = hid.well AND c{x}.i = hid.i' for x in (8, 15, 25))}"""
add("self_ncc", lambda s, d: paths.self_match_features(well_ev(s, d)), _NCC)
add("spectrum", lambda s, d: paths.spectrum_features(well_user(s, d)), f"""WITH {USER}, v AS (SELECT well, GR - avg(GR) OVER (PARTITION BY well) AS v, row_number() OVER (PARTITION BY well ORDER BY row_idx) - 1 AS j, count(*) OVER (PARTITION BY well) AS n FROM us WHERE TVT_input IS NULL AND GR IS NOT NULL),
    f AS (SELECT well, n, v, j, unnest(range(1, n // 2 + 1)) AS k FROM v WHERE n >= 3), p AS (SELECT well, n, k, sum(v * cos(2 * pi() * k * j / n)) ** 2 + sum(v * sin(2 * pi() * k * j / n)) ** 2 AS power FROM f GROUP BY well, n, k),
    b AS (SELECT well, arg_max(k, (round(power, 6), -k)) AS k, any_value(n) AS n, max(power) AS power FROM p GROUP BY well) SELECT w.well, {R('k::DOUBLE / n')} AS fft_freq, {R('ln(1 + power)')} AS fft_log_power FROM (SELECT DISTINCT well FROM us) w LEFT JOIN b USING (well)""")

# Files of wells, written from the tables and read back; tables and files that a run leaves.


def _files(read):
    return lambda s, d: read(s, well_files(s, d))


def _back(s, df, *columns):
    path = scratch.fresh(s, "sink")
    wells.write_table(df, path, list(columns) or None)
    return s.read.parquet(path)


_HZ = ["MD", "X", "Y", "Z", *wells.TOPS, "GR", "TVT", "TVT_input"]
_HZ_SQL = f"SELECT well, row_idx, {', '.join(R(f'TVT + {10 * (i + 1)}') + f' AS {t}' for i, t in enumerate(wells.TOPS))}, {RS('MD', 'X', 'Y', 'Z', 'GR', 'TVT', 'TVT_input')} FROM us WHERE split = 'train'"
add("csv_list_wells", _files(lambda s, f: wells.list_wells(s, f"{f}/test")), f"WITH {USER} SELECT DISTINCT well FROM us WHERE split = 'test'")
add("csv_horizontal", _files(lambda s, f: wells.read_horizontal(s, f"{f}/train", skip_bad=True).select(*ID, *_HZ)), f"WITH {USER} {_HZ_SQL}")
add("csv_horizontal_test", _files(lambda s, f: wells.read_horizontal(s, f"{f}/test", "test")), f"WITH {USER} SELECT well, row_idx, {RS('MD', 'X', 'Y', 'Z', 'GR', 'TVT_input')} FROM us WHERE split = 'test'")
add("csv_projected", _files(lambda s, f: wells.read_horizontal(s, f"{f}/test", "test", ["X", "Y"])), f"WITH {USER} SELECT well, {RS('X', 'Y')} FROM us WHERE split = 'test'")
add("csv_typewells", _files(lambda s, f: wells.read_typewells(s, f"{f}/train")), f"WITH {USER}, {USER_TW} SELECT well, {RS('TVT', 'GR')}, Geology FROM ut WHERE split = 'train'")


def _four(s, folder):
    tables = wells.load_train_test(s, folder, skip_bad=True)
    parts = [t.select(F.lit(i).alias("part"), "well", F.col("GR")) for i, t in enumerate(tables)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("part").agg(F.count("*").alias("rows"), F.count_distinct("well").alias("wells"), F.sum("GR").alias("gr"))


add("csv_four_tables", _files(_four), f"WITH {USER}, {USER_TW}, q AS (SELECT CASE split WHEN 'train' THEN 0 ELSE 2 END AS part, well, GR FROM us UNION ALL SELECT CASE split WHEN 'train' THEN 1 ELSE 3 END, well, GR FROM ut) SELECT CAST(part AS INTEGER) AS part, count(*) AS rows, count(DISTINCT well) AS wells, {R('sum(GR)')} AS gr FROM q GROUP BY part")
_CACHED = ["well", "row_idx", "TVT_input", *features.FEATURES, "TVT"]
add("feature_cache", lambda s, d: _back(s, features.feature_table(well_ev(s, d)), *_CACHED), ORACLES["feature_table"])
_SINGLE = ["GR_z", "tvt_planefit_pred", "md_to_visible_end", "GR_roll_mean_50", "GR_roll_std_200", "GR_diff_20", "inclination", "X"]
add("features_f32", lambda s, d: features.feature_table(well_ev(s, d), parity_f32=True).select(*ID, *[F.col(f).cast("double").alias(f) for f in _SINGLE]), f"WITH {EV}, {PF}, {CONST}, {DERIV} SELECT well, row_idx, " + ", ".join(f"{R(f'CAST(CAST({_FEATURE_SQL.get(f, f)} AS FLOAT) AS DOUBLE)')} AS {f}" for f in _SINGLE) + " FROM der3 JOIN con USING (well) JOIN pf USING (well)")
_PREDICTED = lambda s, d: _pred(s, d).select(*ID, F.col("p").alias("tvt_pred"), "TVT", "is_hidden")
add("oof_table", lambda s, d: _back(s, _PREDICTED(s, d), *ID, "tvt_pred", "TVT", "is_hidden"), f"{PRED} SELECT well, row_idx, {R('p')} AS tvt_pred, {RS('TVT')}, is_hidden FROM pred")
add("test_pred_table", lambda s, d: _back(s, _PREDICTED(s, d), *ID, "tvt_pred", "is_hidden"), f"{PRED} SELECT well, row_idx, {R('p')} AS tvt_pred, is_hidden FROM pred")
add("profile_table", lambda s, d: _back(s, _profile(s, d, "n_rows", "visible_ratio", "GR_mean")), f"{ALLPROF} SELECT split, well, n_rows, {RS('visible_ratio', 'GR_mean')} FROM jp")


def _submitted(s, d):
    path = scratch.fresh(s, "submission")
    wells.write_submission(_PREDICTED(s, d), path)
    return s.read.schema("id string, tvt double").option("header", True).csv(path)


add("submission_csv", _submitted, f"{PRED} SELECT well || '_' || row_idx AS id, {R('p')} AS tvt FROM pred WHERE is_hidden")


def _summarised(s, d):
    path = scratch.fresh(s, "summary.json")
    wells.write_summary(profile.split_summary(_profile(s, d, "*")), path)
    of = "n_wells long, n_rows_max long, visible_ratio_p50 double, MD_step_modal_unique array<struct<value: double, count: long>>"
    read = s.read.schema(f"test struct<{of}>, train struct<{of}>").option("multiLine", True).json(path)
    rows = read.select(F.explode(F.array(*[F.struct(F.lit(k).alias("split"), F.col(k).alias("v")) for k in ("test", "train")])).alias("r"))
    return rows.select("r.split", "r.v.n_wells", "r.v.n_rows_max", "r.v.visible_ratio_p50", F.col("r.v.MD_step_modal_unique")[0]["value"].alias("top_step"))


add("summary_json", _summarised, f"{ALLPROF}, f AS (SELECT split, v, row_number() OVER (PARTITION BY split ORDER BY c DESC, w) AS rank FROM (SELECT split, round_even(MD_step_modal * 1000, 0) / 1000 AS v, count(*) AS c, min(well) AS w FROM jp GROUP BY ALL)) SELECT jp.split, count(*) AS n_wells, max(n_rows) AS n_rows_max, {R('quantile_cont(visible_ratio, 0.5)')} AS visible_ratio_p50, {R('any_value(f.v)')} AS top_step FROM jp JOIN f ON f.split = jp.split AND f.rank = 1 GROUP BY jp.split")

# An extension: windows of time.
add("time_windows", lambda s, d: causal.windowed(table(s, d, "events")), f"SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, {R('avg(value)')} AS mean FROM events GROUP BY ALL")
