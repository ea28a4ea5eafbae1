"""The feature query: a scan, one aggregate per well, windows, 36 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.scalar import ratio
from lithoframe.operators import planefit, sequence

# The feature columns in order: fixed values.
FEATURES = [
    "MD", "X", "Y", "Z", "GR", "GR_z", "tvt_planefit_pred", "tvt_input_visible_last", "md_to_visible_end", "x_to_visible_end", "y_to_visible_end", "z_to_visible_end",
    "visible_md_max", "visible_n", "visible_ratio", "pf_a", "pf_b", "pf_c", "pf_d", "gr_mean", "gr_std", "dX", "dY", "dZ", "d2Z", "lateral_velocity", "inclination",
    *[f"GR_roll_mean_{w}" for w in sequence.ROLL_WINDOWS], *[f"GR_roll_std_{w}" for w in sequence.ROLL_WINDOWS], *[f"GR_diff_{k}" for k in sequence.DIFF_LAGS],
]


def well_constants(h: DataFrame, key: str = "well") -> DataFrame:
    """Everything that is constant in a well, from one aggregate with map-side combination."""
    stats = h.groupBy(key).agg(*sequence.anchor_aggregates(), *sequence.zscore_aggregates(), *planefit.moment_aggregates())
    a = F.col("anchor")
    return stats.select(
        key, a["MD"].alias("visible_md_max"), a["TVT"].alias("tvt_input_visible_last"), a["X"].alias("x_last"), a["Y"].alias("y_last"), a["Z"].alias("z_last"),
        F.col("n_seen").cast("int").alias("visible_n"), ratio("n_seen", "n").alias("visible_ratio"), "gr_mean", "gr_std", *[c.alias(n) for n, c in planefit.solve_moments().items()],
    )


def feature_table(h: DataFrame, key: str = "well", order: str = "row_idx", parity_f32: bool = False, segment_rows: int = 100_000) -> DataFrame:
    """``well, row_idx, TVT_input``, the 36 features and ``TVT`` if it is there; float features are cast to 32 bits only if asked for.

    Rolling frames and differences run over all rows, hidden ones too; a filter
    on rows belongs behind this query. A well of more than ``segment_rows`` rows
    is dealt to several tasks; ``order`` numbers its rows from 0 without gaps.
    """
    rows = h.join(well_constants(h, key), key)
    c = F.col
    made = {"GR_z": (c("GR") - c("gr_mean")) / c("gr_std"), "tvt_planefit_pred": planefit.predict(), "md_to_visible_end": c("MD") - c("visible_md_max"), "x_to_visible_end": c("X") - c("x_last"), "y_to_visible_end": c("Y") - c("y_last"), "z_to_visible_end": c("Z") - c("z_last")}
    framed = lambda w: sequence.derivatives(w) | sequence.rolling("GR", w) | sequence.diffs("GR", w)
    rows = sequence.segmented(rows, framed, max(sequence.ROLL_WINDOWS), key, order, segment_rows)
    wide = rows.select(key, order, "TVT_input", *[made.get(f, c(f)).alias(f) for f in FEATURES], *(["TVT"] if "TVT" in h.columns else []))
    return wide.select(key, order, "TVT_input", *[c(f).cast("float").alias(f) if parity_f32 and f != "visible_n" else c(f) for f in FEATURES], *(["TVT"] if "TVT" in h.columns else []))
