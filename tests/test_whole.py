"""Queries read whole tables: all wells, all rows, the operators' own sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.operators import crossval, paths
from lithoframe.plans import catalog, fixtures

from conftest import DATA

LARGER = DATA.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def many_wells(spark, tmp_path_factory):
    """The smallest tables with 70 wells of about 14 rows."""
    root = tmp_path_factory.mktemp("wells")
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("event_type", F.format_string("w%02d", (F.col("event_id") % 70).cast("int")))
    events.write.parquet(f"{root}/events.parquet")
    spark.read.parquet(f"{DATA}/part.parquet").write.parquet(f"{root}/part.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["beam_path", "particle_path", "particle_path_s"])
def test_paths_of_whole_wells(spark, many_wells, name):
    hidden = fixtures.well_ev(spark, LARGER).filter("TVT_input is null").select("well", "row_idx")
    got = catalog.QUERIES[name](spark, LARGER).toPandas()
    want = {(r.well, r.row_idx) for r in hidden.collect()}
    assert len(got) == len(want) and set(zip(got.well, got.row_idx)) == want
    if name == "beam_path":
        assert [f"beam_{b[4]}_d" for b in paths.BEAMS] == list(got.columns[2:-3])
    few = catalog.QUERIES[name](spark, many_wells).toPandas()
    assert few.well.nunique() == 70 and few.iloc[:, 2:].notna().all(axis=None)


@pytest.mark.parametrize("on", ["tvt", "s"])
def test_particles_are_500(spark, on):
    got = catalog.QUERIES["particle_path" if on == "tvt" else "particle_path_s"](spark, DATA).toPandas().sort_values(["well", "row_idx"])
    want = catalog.tidy(paths.particle_features(catalog._shifted(spark, DATA), catalog._own_typewells(spark, DATA), on=on, n=500)).toPandas().sort_values(["well", "row_idx"])
    assert np.array_equal(got.to_numpy(), want.to_numpy())


def test_nearest_gr_of_all_hidden_rows(spark):
    got = catalog.QUERIES["nearest_gr"](spark, LARGER).toPandas()
    rows = catalog._anchored(spark, LARGER).filter("TVT_input is null and GR is not null").toPandas()
    t = fixtures.typewell(spark, LARGER).toPandas().sort_values("TVT")
    want = {}
    for well, own in rows.groupby("well"):
        near = t[(t.TVT - own.anchor.iloc[0]).abs() <= 40]
        gap = np.abs(own.GR.to_numpy()[:, None] - near.GR.to_numpy()[None, :] % 97)
        want |= {(well, i): v for i, v in zip(own.row_idx, near.TVT.to_numpy()[gap.argmin(1)])}
    assert {(r.well, r.row_idx): r.matched_tvt for r in got.itertuples()} == pytest.approx(want, abs=1e-6)
    assert set(got.row_idx % 7) == set(range(7))


def test_xcorr_searches_whole_wells(spark, tmp_path):
    spark.read.parquet(f"{LARGER}/events.parquet").filter("event_type = 'view' and event_id < 900").write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{LARGER}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["xcorr"](spark, str(tmp_path)).toPandas().set_index("row_idx").sort_index()
    assert list(got.columns) == ["well", "xcorr_best_corr", "xcorr_tvt_delta", "xcorr_best_absdiff"]
    rows = catalog._shifted(spark, str(tmp_path)).toPandas().sort_values("row_idx")
    t = fixtures.typewell(spark, str(tmp_path)).toPandas().sort_values("TVT")
    gr, n, best = rows.GR.to_numpy(float), len(rows), {}
    offsets = range(-120, 121)
    tw = {o: np.interp(rows.TVT + o, t.TVT, t.GR.astype(float) % 97) for o in offsets}
    for i in range(n):
        near = np.arange(max(0, i - 15), min(n, i + 16))
        near = near[np.isfinite(gr[near])]
        best[i] = max(np.corrcoef(gr[near], tw[o][near])[0, 1] for o in offsets if tw[o][near].std() > 1e-9)
    assert n > 150 and list(got.index) == list(range(n))
    assert np.allclose(got.xcorr_best_corr, [best[i] for i in range(n)], atol=1e-5)
    assert got.xcorr_tvt_delta.abs().max() > 40
    at = np.array([tw[int(o)][i] for i, o in enumerate(got.xcorr_tvt_delta)])
    ok = np.isfinite(gr)
    assert np.allclose(got.xcorr_best_absdiff[ok], np.abs(gr - at)[ok], atol=1e-5)


def test_baseline_of_the_operators_own_size(spark, monkeypatch):
    seen = []

    def kept(train, names, target, folds, test, **options):
        seen.append((list(names), folds.select("fold").distinct().count(), set(options) - {"residual_to"}))
        return train.withColumn("fold", F.lit(0)), test

    monkeypatch.setattr(catalog.crossval, "out_of_fold", kept)
    for name in ("oof_gbt", "oof_gbt_residual", "test_mean_pred"):
        catalog.QUERIES[name](spark, DATA)
    assert seen == 3 * [(catalog.features.FEATURES, 5, set())]


def test_folds_of_any_number_of_wells(spark):
    """The SQL of the fold queries lists the shuffled order of 15, 150 and 1500 wells; the query deals any number."""
    names = sorted(f"w{i}" for i in range(2718))
    order = list(names)
    np.random.RandomState(42).shuffle(order)
    got = {r.well: r.fold for r in crossval.fold_map(spark.createDataFrame([(n,) for n in names], "well string")).collect()}
    assert got == {w: i % 5 for i, w in enumerate(order)}


def test_trees_read_parts_worth_a_task(spark, monkeypatch):
    """Hundreds of parts of few rows made each of a tree's jobs slow."""
    parts, fit = [], crossval.GBTRegressor.fit
    monkeypatch.setattr(crossval.GBTRegressor, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or fit(self, df))
    rows = [(f"w{i % 10}", i // 10, float(i % 7), float(i % 7) * 2, 1.0 if i % 3 else None) for i in range(400)]
    t = spark.createDataFrame(rows, "well string, row_idx int, x double, TVT double, TVT_input double").repartition(64)
    oof, mean = crossval.out_of_fold(t, ["x"], "TVT", crossval.fold_map(t, 3), t.drop("TVT"), maxIter=2, maxDepth=3)
    assert parts and len(parts) == 3 and max(parts) <= spark.sparkContext.defaultParallelism
    assert oof.count() == mean.count() == 400 and oof.select("well", "row_idx").distinct().count() == 400
