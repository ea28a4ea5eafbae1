"""Edge cases of the operators, mostly against NumPy and pandas."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lithoframe.functions import scalar
from lithoframe.operators import align, blend, crossval, knn, paths, planefit, post, profile, sequence, statistics
from lithoframe.plans import features
from lithoframe.sources import wells
from lithoframe.streaming import causal

H = "well string, row_idx int, MD double, X double, Y double, Z double, GR double, TVT double, TVT_input double"


def make(spark, spec, seed=0):
    """``spec``: well -> list of visible flags."""
    rng = np.random.default_rng(seed)
    rows = []
    for well, seen in spec.items():
        for i, v in enumerate(seen):
            x, y, z, g = (float(a) for a in rng.normal(0, 10, 4))
            t = 100 + 2 * x - y + 0.5 * z
            rows.append((well, i, float(i), x, y, z, None if i % 7 == 5 else g, t, t if v else None))
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], H)


SPEC = {"none": [0] * 30, "three": [1] * 3 + [0] * 10, "one": [1], "short": [1] * 12 + [0] * 7, "gap": [0] * 5 + [1] * 20 + [0] * 6, "all": [1] * 40}


def by_well(df):
    return {r["well"]: r for r in df.collect()}


def test_features_match_pandas(spark):
    h = make(spark, SPEC)
    got = features.feature_table(h).toPandas().sort_values(["well", "row_idx"])
    assert list(got.columns) == ["well", "row_idx", "TVT_input", *features.FEATURES, "TVT"] and len(features.FEATURES) == 36
    src = h.toPandas().sort_values(["well", "row_idx"])
    for well, g in got.groupby("well"):
        s = src[src.well == well]
        for w in (10, 50, 200):
            np.testing.assert_allclose(g[f"GR_roll_mean_{w}"], s.GR.rolling(w, min_periods=1).mean(), rtol=1e-9)
            np.testing.assert_allclose(g[f"GR_roll_std_{w}"], s.GR.rolling(w, min_periods=1).std().fillna(0), atol=1e-9)
        np.testing.assert_allclose(g.GR_diff_5, s.GR.diff(5), rtol=1e-9)
        np.testing.assert_allclose(g.d2Z, s.Z.diff().diff(), rtol=1e-9)
        assert g.inclination.iloc[0] == 0 and g.lateral_velocity.iloc[0] == 0
        seen = s[s.TVT_input.notna()]
        if len(seen):
            np.testing.assert_allclose(g.md_to_visible_end, s.MD - seen.MD.iloc[-1])
        else:
            assert g.md_to_visible_end.isna().all() and g.tvt_input_visible_last.isna().all()
    assert got[got.well == "short"].GR_diff_20.isna().all()


def test_plane_fit(spark):
    h = make(spark, SPEC)
    for fit in (planefit.plane_fit, planefit.plane_fit_lstsq):
        r = by_well(fit(h))
        assert [r["none"][c] for c in planefit.COEFFICIENTS] == [0, 0, 0, 0]
        assert [r["three"][c] for c in planefit.COEFFICIENTS[:3]] == [0, 0, 0]
        np.testing.assert_allclose([r["gap"][c] for c in planefit.COEFFICIENTS], [2, -1, 0.5, 100], rtol=1e-6)
    line = h.withColumns({"Y": F.col("X"), "Z": F.col("X")})
    assert by_well(planefit.plane_fit(line))["all"]["pf_a"] == 0
    solved = by_well(planefit.plane_fit_lstsq(line))["all"]
    assert abs(solved["pf_a"] - solved["pf_b"]) < 1e-6


def test_profile_edges(spark):
    h = make(spark, SPEC).withColumn("split", F.lit("train"))
    r = by_well(profile.well_profile(h, ["split", "well"]))
    assert (r["gap"].n_visible_runs, r["gap"].n_hidden_runs, r["gap"].trailing_hidden_only) == (1, 2, False)
    assert (r["all"].first_hidden_idx, r["all"].first_hidden_md) == (-1, None)
    assert r["short"].trailing_hidden_only and r["short"].first_hidden_idx == 12
    assert r["one"].MD_step_modal is None and r["one"].MD_steps_unique_count == 0
    assert r["none"].TVT_input_matches_TVT_on_visible is True
    off = h.withColumn("TVT_input", F.col("TVT_input") + 1)
    assert by_well(profile.well_profile(off, ["split", "well"]))["all"].TVT_input_matches_TVT_on_visible is False
    tie = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 1, 2, 4, 6])], "well string, row_idx int, MD double")
    assert profile.step_stats(tie, ["well"]).first().MD_step_modal == 1.0
    assert profile.runs(h.limit(0), ["well"]).count() == 0


def test_input_order_does_not_matter(spark):
    a = features.feature_table(make(spark, SPEC)).orderBy("well", "row_idx").collect()
    b = features.feature_table(make(spark, SPEC).repartition(3, "MD").orderBy(F.desc("X"))).orderBy("well", "row_idx").collect()
    assert [tuple(r)[:2] for r in a] == [tuple(r)[:2] for r in b]
    number = lambda rows: np.array([[np.nan if v is None else v for v in tuple(r)[2:]] for r in rows], float)
    np.testing.assert_allclose(number(a), number(b), rtol=1e-6, atol=1e-6)


def test_segmented_equals_whole(spark):
    h = make(spark, {"a": [1] * 100, "b": [0] * 9})
    whole = h.select("well", "row_idx", sequence.roll_std("GR", 10, sequence.by()).alias("v")).orderBy("well", "row_idx").collect()
    cut = sequence.segmented(h, lambda w: {"v": sequence.roll_std("GR", 10, w)}, 10, rows=17).select("well", "row_idx", "v").orderBy("well", "row_idx").collect()
    for p, q in zip(whole, cut, strict=True):
        assert p[:2] == q[:2] and p.v == pytest.approx(q.v, abs=1e-9)


def test_scalars(spark):
    df = spark.createDataFrame([(float("nan"), 2.5), (1.0, 3.5)], "a double, b double")
    assert scalar.nan_to_null(df).filter("a is null").count() == 1
    assert [r[0] for r in df.select(scalar.round_even("b")).collect()] == [2.0, 4.0]
    assert df.select(scalar.close_to(F.lit(11000.0), F.lit(11000.1)), scalar.close_to(F.lit(None).cast("double"), F.lit(1.0))).first() == (True, False)


def test_nearest_and_imputation(spark):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(0, 1, (5, 2)) * 50, [[0.0, 0.0]] * 3])
    tops = 3 * pts[:, 0] - pts[:, 1] + 7
    p = spark.createDataFrame([(i, float(x), float(y), float(t)) for i, ((x, y), t) in enumerate(zip(pts, tops))], "wid long, x double, y double, top double")
    q = p.select(F.col("wid").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("wid").alias("self"))
    scale = knn.scales(p)
    got = knn.nearest(q, p, 7, scale).toPandas()
    d = np.sqrt((((pts[:, None] - pts[None]) / np.array(scale)) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for qid, g in got.groupby("qid"):
        want = sorted((v, i) for i, v in enumerate(d[qid]))[:7]
        assert [i for _, i in want] == g.sort_values("rank").wid.tolist()
    filled = knn.plane_impute(q, p, ["top"], 7).toPandas().set_index("qid")
    np.testing.assert_allclose(filled.top.sort_index(), tops, atol=1e-6)
    alone = knn.plane_impute(q.limit(1), p.filter(F.col("wid") == q.first().qid), ["top"]).first()
    assert alone.min_dist is None and alone.top == pytest.approx(tops[q.first().qid])
    assert knn.nearest(q, p.limit(0), 3, (1.0, 1.0)).count() == 0
    mean = knn.idw_impute(q, p, "top", 5).toPandas()
    assert len(mean) == len(pts)


def test_folds(spark):
    w = spark.createDataFrame([(f"w{i:02d}",) for i in range(8)] * 2, "well string")
    folds = {r.well: r.fold for r in crossval.fold_map(w, 8, 42).collect()}
    assert [k for k, _ in sorted(folds.items(), key=lambda i: i[1])] == ["w01", "w05", "w00", "w07", "w02", "w04", "w03", "w06"]
    e = spark.createDataFrame([(1.0, 3.0, True), (1.0, 1.0, False)], "y double, p double, h boolean")
    assert e.agg(crossval.rmse("y", "p", F.col("h")), crossval.rmse("y", "p", F.lit(False))).first() == (2.0, None)
    a = spark.createDataFrame([("a_1",), ("a_2",)], "id string")
    b = spark.createDataFrame([("a_1", 5.0)], "id string, tvt double")
    assert {tuple(r) for r in crossval.predictions_for(a, b, -1.0).collect()} == {("a_1", 5.0), ("a_2", -1.0)}
    assert [r.id for r in crossval.id_mismatch(a, b).collect()] == ["a_2"]


def test_interpolation_clamps(spark):
    t = spark.createDataFrame([(0.0, 1.0), (100.0, 11.0), (300.0, 5.0)], "TVT double, GR double")
    xs = [-5.0, 0.0, 50.0, 100.0, 250.0, 300.0, 900.0]
    r = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    got = {v.x: v.tw_gr for v in align.interpolate(r, "x", t).collect()}
    np.testing.assert_allclose([got[x] for x in xs], np.interp(xs, [0, 100, 300], [1, 11, 5]))
    assert got[None] is None


def test_boundaries_and_resampling(spark):
    t = spark.createDataFrame([(float(i), float(i * i), "ab"[i > 4]) for i in range(10)], "TVT double, GR double, Geology string")
    r = spark.createDataFrame([(3.0,), (7.5,)], "x double")
    assert {(v.x, v.boundary_dist) for v in align.boundary_distance(r, "x", t).collect()} == {(3.0, 2.0), (7.5, 2.5)}
    assert align.boundary_distance(r, "x", t.withColumn("Geology", F.lit("a"))).filter("boundary_dist is not null").count() == 0
    assert align.resample(t, 2.0).count() == 5


def test_affine_calibration_fallbacks(spark):
    rows = [("few", float(i), float(i)) for i in range(5)] + [("flat", float(i), 3.0) for i in range(30)] + [("fit", 2.0 * i + 1, float(i)) for i in range(30)] + [("none", None, 1.0)]
    r = by_well(align.affine_calibration(spark.createDataFrame(rows, "well string, GR double, tw_gr double")))
    assert (r["few"].a_cal, r["few"].b_cal) == (1.0, 0.0) and r["flat"].a_cal == 1.0 and r["flat"].b_cal == 11.5
    assert (round(r["fit"].a_cal, 9), round(r["fit"].b_cal, 9)) == (2.0, 1.0) and tuple(r["none"])[1:] == (1.0, 0.0)


def test_savgol(spark):
    h = make(spark, {"long": [1] * 40, "mid": [1] * 10, "tiny": [1] * 3})
    got = post.savgol(h, "Z").toPandas().sort_values("row_idx")
    for well, size in (("long", 17), ("mid", 9)):
        g = got[got.well == well]
        z = g.Z.to_numpy()
        half = size // 2
        want = [np.polyval(np.polyfit(np.arange(size), z[a : a + size], 3), i - a) for i in range(len(z)) for a in [min(max(i - half, 0), len(z) - size)]]
        np.testing.assert_allclose(g.smooth, want, atol=1e-8)
    tiny = got[got.well == "tiny"]
    assert (tiny.smooth == tiny.Z).all()


def test_stacking(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(0, 1, (3, 400))
    y = 0.7 * a + 0.3 * b + 0.01 * rng.normal(0, 1, 400)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": -c, "y": y}))
    w = blend.stack(df, ["a", "b", "c"], "y", alpha=1e-6)
    assert abs(w["a"] - 0.7) < 0.01 and abs(w["b"] - 0.3) < 0.01 and min(w.values()) >= 0
    h = blend.hill_climb(df, ["a", "b", "c"], "y")
    assert abs(h["a"] - 0.7) < 0.06 and abs(sum(h.values()) - 1) < 1e-9
    assert blend.keep_best(df, ["a", "b", "c"], "y")[0] == "stack"
    m = -np.eye(2)[0]
    assert (blend.nonnegative_ridge(np.eye(2), m) == 0).all()


def beam_slow(gr, tw, start, size, move, scale):
    beams = {start: (0.0, [])}
    for g in gr:
        new = {}
        for s in sorted(beams):
            cost, path = beams[s]
            for d in (-1, 0, 1):
                if 0 <= s + d < len(tw):
                    v = cost + move * abs(d)
                    if s + d not in new or v < new[s + d][0] - 1e-12:
                        new[s + d] = (v, [*path, s + d])
        new = {s: (v + (g - tw[s]) ** 2 / scale, p) for s, (v, p) in new.items()}
        beams = dict(sorted(sorted(new.items()), key=lambda i: i[1][0])[:size])
    return min(sorted(beams.items()), key=lambda i: i[1][0])[1]


def test_paths(spark):
    rng = np.random.default_rng(5)
    tw = rng.normal(50, 20, 60)
    gr = tw[np.clip(30 + np.cumsum(rng.integers(-1, 2, 40)), 0, 59)] + rng.normal(0, 1, 40)
    path = paths.beam_path(gr, tw, 30, 10, 2.0, 10.0)
    assert np.abs(np.diff(path)).max() <= 1
    cost, slow = beam_slow(gr, tw, 30, 10, 2.0, 10.0)
    mine = sum(2.0 * abs(b - a) for a, b in zip([30, *path[:-1]], path)) + ((gr - tw[path]) ** 2 / 10).sum()
    assert mine == pytest.approx(cost)
    mean, sd = paths.particle_path(gr, np.zeros(40), np.arange(40.0), np.arange(60.0), tw, 30.0, 0.0, 1, n=300, sigma=5.0)
    again, _ = paths.particle_path(gr, np.zeros(40), np.arange(40.0), np.arange(60.0), tw, 30.0, 0.0, 1, n=300, sigma=5.0)
    assert (mean == again).all() and (sd >= 0).all()
    tvt, score = paths.self_match(tw, np.arange(60.0), tw[20:41], 8, 1)
    assert tvt[10] == 30 and score[10] == pytest.approx(1, abs=1e-3)
    assert np.isnan(paths.self_match(tw[:5], np.arange(5.0), tw, 8)[0]).all()
    f, _ = paths.spectrum(np.sin(2 * np.pi * np.arange(64) / 8))
    assert f == 1 / 8


def test_keyed_boundaries(spark):
    t = spark.createDataFrame([("a", 1.0, "x"), ("a", 5.0, "y"), ("a", 900.0, "z"), ("b", 1.0, "x"), ("b", 2.0, "x")], "well string, TVT double, Geology string")
    r = spark.createDataFrame([("a", -300.0), ("a", 452.5), ("a", 453.0), ("a", 2000.0), ("a", None), ("b", 1.0), ("c", 1.0)], "well string, x double").withColumn("bucket", F.lit(1))
    got = {(v.well, v.x): (v.boundary_dist, v.cut) for v in align.boundary_distance(r, "x", t, ["well"], nearest="cut").collect()}
    assert got == {("a", -300.0): (305.0, 5.0), ("a", 452.5): (447.5, 5.0), ("a", 453.0): (447.0, 900.0), ("a", 2000.0): (1100.0, 900.0), ("a", None): (None, None), ("b", 1.0): (None, None), ("c", 1.0): (None, None)}


def test_self_match_is_the_best_window(spark):
    rng = np.random.default_rng(3)
    seen, gr, tvt = rng.normal(50, 9, 90), rng.normal(50, 9, 37), np.arange(90.0)
    for half, stride in ((4, 1), (8, 3)):
        own, score = paths.self_match(seen, tvt, gr, half, stride)
        wide = np.concatenate([[gr[0]] * half, gr, [gr[-1]] * half])
        unit = lambda v: (v - v.mean()) / (v.std() + 1e-6)
        for i in range(37):
            c = [(unit(wide[i : i + 2 * half + 1]) * unit(seen[s : s + 2 * half + 1])).mean() for s in range(0, 90 - 2 * half, stride)]
            assert own[i] == int(np.argmax(c)) * stride + half and score[i] == pytest.approx(max(c), abs=1e-8)


def test_cumulative_product(spark):
    z = [0.0, 2.0, 1.0, -3.0, -3.0, 1.0]
    rows = spark.createDataFrame([("w", i, v) for i, v in enumerate(z)], "well string, row_idx int, Z double")
    got = [(r.dZ_prod_sign, r.dZ_prod_log) for r in sequence.cumulative_product(rows, sequence.by()).orderBy("row_idx").collect()]
    assert got[0] == (None, None) and [g[0] for g in got[1:]] == [1, -1, 1, 0, 0]
    assert np.allclose([g[1] for g in got[1:4]], np.log([2, 2, 8]))


def test_train_run(spark, tmp_path):
    h = make(spark, {f"w{i}": [1] * 6 + [0] * 6 for i in range(6)})
    test = make(spark, {"t": [1] * 6 + [0] * 6}, 4).drop("TVT")
    got = crossval.train_run(h, test.withColumn("TVT", F.lit(None).cast("double")), ["X", "Y", "Z"], "TVT", str(tmp_path / "run"), (1, 2), 2, pseudo=True, maxIter=2, maxDepth=2)
    assert set(got) == {"rmse", "rmse_hidden", "mean_best_iter"} and got["mean_best_iter"] in (1, 2) and got["rmse"] > 0
    oof = spark.read.parquet(str(tmp_path / "run/oof"))
    assert oof.columns == ["well", "row_idx", "tvt_pred", "TVT", "is_hidden"] and oof.count() == 72
    for name in ("test", "test_pseudo"):
        assert spark.read.parquet(str(tmp_path / f"run/{name}")).count() == 12


def test_sources_round_trip(spark, tmp_path):
    d = tmp_path / "train"
    d.mkdir()
    cols = wells.HORIZONTAL["train"]
    for w in ("bb", "aa"):
        (d / f"{w}__horizontal_well.csv").write_text(",".join(cols) + "\n" + "\n".join(",".join("" if c == "TVT_input" and i > 1 else str(float(i)) for c in cols) for i in range(4)) + "\n")
        (d / f"{w}__typewell.csv").write_text("TVT,GR,Geology\n1.0,2.0,g\n2.0,,\n")
    assert [r.well for r in wells.list_wells(spark, str(d)).collect()] == ["aa", "bb"]
    h = wells.read_horizontal(spark, str(d))
    assert h.columns[:2] == ["well", "row_idx"] and h.count() == 8 and h.filter("TVT_input is null").count() == 4
    assert wells.read_typewells(spark, str(d)).filter("GR is null").count() == 2
    assert wells.submission_template(h).count() == 4
    table = features.feature_table(h)
    wells.write_table(table, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 8
    preds = h.select("well", "row_idx", F.col("MD").alias("tvt_pred"), F.col("TVT_input").isNull().alias("is_hidden"))
    wells.write_submission(preds, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).orderBy("id").first().id == "aa_2"
    p = profile.joined_profile(h.withColumn("split", F.lit("train")), wells.read_typewells(spark, str(d)).withColumn("split", F.lit("train")), ["split", "well"])
    summary = wells.write_summary(profile.split_summary(p), str(tmp_path / "x.json"))
    assert summary["train"]["n_wells"] == 2 and json.loads((tmp_path / "x.json").read_text()) == json.loads(json.dumps(summary))
    (tmp_path / "c.json").write_text('{"seed": 1}')
    assert wells.load_config(str(tmp_path / "c.json")) == {"seed": 1}


def test_statistics(spark):
    h = make(spark, {"a": [1] * 10 + [0] * 10, "b": [1] * 3})
    assert statistics.gated(h, ["GR", "TVT_input"], 0.6) == ["GR"] or statistics.gated(h, ["GR", "TVT_input"], 0.6)
    r = by_well(statistics.detrend(h).filter("row_idx = 1"))
    assert r["b"].detrended == r["b"].GR
    masked = statistics.tail_mask(h, 0.5).groupBy("well").agg(F.count("TVT_masked").alias("n"))
    assert {(x.well, x.n) for x in masked.collect()} == {("a", 10), ("b", 1)}


def test_stream_and_table_agree(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    q = causal.windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: {tuple(map(str, r)) for r in df.select("start", "event_type", "n").collect()}
    assert rows(spark.table("w")) == rows(causal.windowed(e))


def test_pair_correlation_keeps_digits_beside_large_values():
    """Sums over all rows would make a flat window vary, and a quiet one's correlation wrong, after a stretch of large values."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, 2000), rng.normal(0, 1, (2000, 2))
    x[:900] *= 1e5
    y[:900] *= 1e5
    y[1200:1500, 1] = 97.3
    x[rng.random(2000) < 0.05] = np.nan
    got = align._pair_correlation(x, y, 15)
    for i in (0, 10, 450, 1000, 1190, 1700, 1999):
        a, ok = x[max(0, i - 15) : i + 16], np.isfinite(x[max(0, i - 15) : i + 16])
        for k in (0, 1):
            assert abs(got[i, k] - np.corrcoef(a[ok], y[max(0, i - 15) : i + 16, k][ok])[0, 1]) < 1e-9
    assert np.isnan(got[1215:1485, 1]).all() and np.isfinite(got[1215:1485, 0]).all()


def test_self_match_compares_equal_windows_once(monkeypatch):
    """A log that repeats costs what its distinct windows cost, with the results of comparing every pair."""
    rng = np.random.default_rng(5)
    once = np.round(rng.exponential(50, 90), 1)
    v = np.tile(once, 8)
    t = rng.normal(0, 1, 200)
    numbers = paths.window_numbers(v, 17)
    assert len(np.unique(numbers)) == 90 and (numbers[:500] == numbers[90:590]).all()
    for half in (3, 8):
        win = 2 * half + 1
        own = np.concatenate([np.full(half, v[200]), v[200:], np.full(half, v[-1])])
        got = paths.self_match(v[:200], t, v[200:], half)
        for i in range(0, len(v) - 200, 7):
            a = own[i : i + win]
            c = [np.round(((a * b).mean() - a.mean() * b.mean()) / ((a.std() + 1e-6) * (b.std() + 1e-6)), 9) for b in (v[s : s + win] for s in range(0, 200 - win + 1, 3))]
            k = int(np.argmax(c))
            assert got[0][i] == t[3 * k + half] and abs(got[1][i] - c[k]) < 2e-9
