"""Per-well profiles and per-split summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.scalar import close_to, round_even, visible


def spans(c: str, names: tuple[str, ...] = ("min", "max", "range")) -> list[Column]:
    made = {"min": F.min(c), "max": F.max(c), "range": F.max(c) - F.min(c)}
    return [made[n].alias(f"{c}_{n}") for n in names]


def runs(df: DataFrame, key: list[str], order: str = "row_idx", seen: str = "TVT_input") -> DataFrame:
    """Runs of visible and hidden rows: ``key, is_visible, start, end`` (inclusive)."""
    w = Window.partitionBy(*key).orderBy(order)
    mask = visible(seen)
    edge = F.coalesce((F.lag(mask.cast("int")).over(w) != mask.cast("int")).cast("int"), F.lit(0))
    numbered = df.select(*key, order, mask.alias("is_visible"), edge.alias("edge")).withColumn("run", F.sum("edge").over(w))
    return numbered.groupBy(*key, "is_visible", "run").agg(F.min(order).alias("start"), F.max(order).alias("end")).drop("run")


def run_shape(df: DataFrame, key: list[str], order: str = "row_idx", seen: str = "TVT_input") -> DataFrame:
    """Numbers of runs, and whether the hidden rows are one block at the end."""
    counts = runs(df, key, order, seen).groupBy(*key).agg(
        F.count_if("is_visible").alias("n_visible_runs"), F.count_if(~F.col("is_visible")).alias("n_hidden_runs"), F.max(F.when(~F.col("is_visible"), F.col("end"))).alias("last_hidden"), F.max("end").alias("last")
    )
    trailing = (F.col("n_hidden_runs") == 1) & (F.col("last_hidden") == F.col("last"))
    return counts.select(*key, "n_visible_runs", "n_hidden_runs", F.coalesce(trailing, F.lit(False)).alias("trailing_hidden_only"))


def step_stats(df: DataFrame, key: list[str], value: str = "MD", order: str = "row_idx") -> DataFrame:
    """Least, largest, modal step and the number of steps that differ to 3 decimals; a mode's tie goes to the smallest."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    return df.select(*key, step.alias("step")).groupBy(*key).agg(
        F.mode(F.rint("step"), True).alias(f"{value}_step_modal"), F.min("step").alias(f"{value}_step_min"), F.max("step").alias(f"{value}_step_max"), F.count_distinct(round_even("step", 3)).alias(f"{value}_steps_unique_count")
    )


def well_profile(h: DataFrame, key: list[str], order: str = "row_idx") -> DataFrame:
    """Counts, ranges, GR statistics (sample deviation), the hidden zone's start, and whether input equals target where visible."""
    seen = visible()
    same = F.coalesce(F.bool_and(F.when(seen, close_to("TVT_input", "TVT"))), F.lit(True))
    hidden_order = F.when(~seen, F.col(order))
    flat = h.groupBy(*key).agg(
        F.count("*").alias("n_rows"), F.count("TVT_input").alias("n_visible"), F.count_if(~seen).alias("n_hidden"), (F.count("TVT_input") / F.count("*")).alias("visible_ratio"),
        *spans("MD"), *spans("X", ("min", "max")), *spans("Y", ("min", "max")), *spans("Z"), *spans("GR", ("min", "max")), F.avg("GR").alias("GR_mean"), F.stddev_samp("GR").alias("GR_std"),
        F.coalesce(F.min(hidden_order), F.lit(-1)).alias("first_hidden_idx"), F.min_by("MD", hidden_order).alias("first_hidden_md"), *spans("TVT"),
        F.when(F.count("TVT") > 0, same).alias("TVT_input_matches_TVT_on_visible"),
    )
    flat = flat.withColumn("first_hidden_md", F.when(F.col("first_hidden_idx") >= 0, F.col("first_hidden_md")))
    return flat.join(step_stats(h, key, "MD", order), key).join(run_shape(h, key, order), key)


def typewell_profile(t: DataFrame, key: list[str], order: str = "TVT") -> DataFrame:
    step = F.col("TVT") - F.lag("TVT").over(Window.partitionBy(*key).orderBy(order))
    return t.withColumn("__step", F.rint(step * 10)).groupBy(*key).agg(
        F.count("*").alias("typewell_n_rows"), F.min("TVT").alias("typewell_TVT_min"), F.max("TVT").alias("typewell_TVT_max"), F.avg("GR").alias("typewell_GR_mean"), F.stddev_samp("GR").alias("typewell_GR_std"),
        (F.mode("__step", True) / 10).alias("typewell_TVT_step_modal"), F.count_distinct("Geology").alias("typewell_geology_unique_count"), F.count("Geology").alias("typewell_geology_n_labeled"),
    )


def joined_profile(h: DataFrame, t: DataFrame, key: list[str], order: str = "row_idx") -> DataFrame:
    """Profiles of a well and its typewell in one row, and whether the typewell covers the well's TVT."""
    both = well_profile(h, key, order).join(typewell_profile(t, key), key)
    covers = (F.col("typewell_TVT_min") <= F.col("TVT_min")) & (F.col("typewell_TVT_max") >= F.col("TVT_max"))
    return both.withColumn("typewell_covers_horizontal_tvt", F.when(F.col("TVT_min").isNotNull(), covers))


def frequencies(df: DataFrame, value: Column, top: int | None = None, group: list[str] | None = None, tie: str = "well") -> DataFrame:
    """Counts of values, most frequent first, ties by the least ``tie``; ``rank`` from 1, at most ``top`` per group."""
    group = group or []
    counts = df.groupBy(*group, value.alias("value")).agg(F.count("*").alias("count"), F.min(tie).alias("first"))
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(F.desc("count"), "first")
    ranked = counts.withColumn("rank", F.row_number().over(w))
    return (ranked.filter(F.col("rank") <= top) if top else ranked).drop("first")


def quantiles(c: str, points: tuple[float, ...] = (0.25, 0.5, 0.75)) -> list[Column]:
    """Exact quantiles with linear interpolation."""
    return [F.percentile(c, F.lit(p)).alias(f"{c}_p{round(p * 100)}") for p in points]


def split_summary(profile: DataFrame) -> DataFrame:
    """One row per split over its wells' profiles; integer quantiles are cut to whole numbers."""
    whole = lambda c, p: F.percentile(c, F.lit(p)).cast("int")
    flat = profile.groupBy("split").agg(
        F.count("*").alias("n_wells"), F.max("MD_step_max").alias("MD_step_max_max"), F.min("MD_step_min").alias("MD_step_min_min"),
        F.min("n_rows").alias("n_rows_min"), F.max("n_rows").alias("n_rows_max"), whole("n_rows", 0.5).alias("n_rows_p50"), whole("n_rows", 0.95).alias("n_rows_p95"),
        F.min("visible_ratio").alias("visible_ratio_min"), F.max("visible_ratio").alias("visible_ratio_max"), *quantiles("visible_ratio"),
        F.count_if(F.col("n_hidden") > 0).alias("wells_with_eval_zone"), F.count_if("trailing_hidden_only").alias("wells_with_trailing_hidden_only"),
        F.count_if(F.col("n_visible_runs") > 1).alias("wells_with_visible_runs_gt_1"), F.count_if(F.col("n_hidden_runs") > 1).alias("wells_with_hidden_runs_gt_1"), F.count_if(F.col("n_hidden") == 0).alias("wells_zero_hidden"),
        F.min("GR_mean").alias("GR_mean_min"), F.max("GR_mean").alias("GR_mean_max"), *quantiles("GR_mean", (0.5,)), *quantiles("GR_std", (0.5,)),
        F.min("typewell_n_rows").alias("typewell_n_rows_min"), F.max("typewell_n_rows").alias("typewell_n_rows_max"), whole("typewell_n_rows", 0.5).alias("typewell_n_rows_p50"),
        *quantiles("Z_range", (0.5, 0.95)), F.min("TVT_min").alias("TVT_min_min"), F.max("TVT_max").alias("TVT_max_max"), *quantiles("TVT_range", (0.5, 0.95)),
        F.bool_and("TVT_input_matches_TVT_on_visible").alias("TVT_input_eq_TVT_on_visible_all_wells"), F.count_if("typewell_covers_horizontal_tvt").alias("typewell_covers_horizontal_tvt_count"),
        *[f.alias(f"typewell_{c}_{n}") for c in ("geology_n_labeled", "geology_unique_count") for n, f in (("p50", whole(f"typewell_{c}", 0.5)), ("min", F.min(f"typewell_{c}")), ("max", F.max(f"typewell_{c}")))],
    )
    as_pairs = lambda d, name: d.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias(name)).withColumn(name, F.transform(name, lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))))
    md = as_pairs(frequencies(profile, round_even("MD_step_modal", 3), None, ["split"]), "MD_step_modal_unique")
    tw = as_pairs(frequencies(profile, round_even("typewell_TVT_step_modal", 2), 5, ["split"]), "typewell_TVT_step_modal_unique")
    return flat.join(md, "split").join(tw, "split")
