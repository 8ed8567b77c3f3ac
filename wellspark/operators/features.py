"""The 20-column feature frame: relative deltas, slope, residuals and z-scores per grid point."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from wellspark.functions.scalar import freq_bin, micros, safe_divide
from wellspark.operators.baseline import baseline_by_bin, scale_profile, unpivot
from wellspark.operators.clean import sampling_step, whole_points
from wellspark.operators.ordering import neighbours, on_blocks, with_halo
from wellspark.schema import FREQUENCY, MODELLED, BaselineSettings, FeatureSettings
from wellspark.staging import stage, together

FEATURES = (
    "pressure_delta", "pressure_slope", "current_delta", "temperature_delta",
    "pressure", "pressure_expected", "pressure_residual", "pressure_scale", "pressure_z",
    "current", "current_expected", "current_residual", "current_scale", "current_z",
    "temperature", "temperature_expected", "temperature_residual", "temperature_scale", "temperature_z",
    "frequency",
)


def window_params(
    base: DataFrame, cfg: FeatureSettings, metrics: Sequence[str] = tuple(MODELLED)
) -> DataFrame:
    """Rows per window, shift and minimum count of every (well, metric): ``(well, metric, w, s, mp)``."""
    steps = sampling_step(unpivot(base, ["well", "ts"], metrics), ["well", "metric"])
    fraction = min(1.0, cfg.min_samples / max(1, cfg.window_minutes))
    w = F.greatest(whole_points(cfg.window_minutes, "step"), F.lit(1))
    needed = F.least(w, F.ceil(w * F.lit(fraction)).cast("int"))
    return steps.select(
        "well",
        "metric",
        w.alias("w"),
        F.greatest(whole_points(cfg.shift_minutes, "step"), F.lit(1)).alias("s"),
        F.greatest(needed, F.lit(1)).alias("mp"),
    )


def well_profile(
    base: DataFrame, baseline: DataFrame | None, cfg: FeatureSettings, bcfg: BaselineSettings
) -> DataFrame:
    """One row per well with every per-(well, metric) constant the features need, prefixed by feature name."""
    keys = ["well", "metric"]
    if baseline is None:
        rows = window_params(base, cfg)
        rows = rows.withColumns({"fallback": F.lit(None).cast("double"), "fill": F.lit(None).cast("double")})
    else:
        sizes, scales = together(
            base.sparkSession,
            lambda: stage(window_params(base, cfg), "window-params"),
            lambda: stage(scale_profile(base, baseline, bcfg.bin_width), "scales"),
        )
        rows = sizes.join(scales, keys, "full")
    columns = []
    for metric, name in MODELLED.items():
        own = F.col("metric") == metric
        for c in ("w", "s", "mp"):
            columns.append(F.coalesce(F.max(F.when(own, F.col(c))), F.lit(1)).alias(f"{name}_{c}"))
        for c in ("fallback", "fill"):
            columns.append(F.max(F.when(own, F.col(c))).alias(f"{name}_{c}"))
    constants = rows.groupBy("well").agg(*columns)
    wells = base.select("well").distinct()
    sizes = {f"{n}_{c}": F.coalesce(f"{n}_{c}", F.lit(1)) for n in MODELLED.values() for c in ("w", "s", "mp")}
    return wells.join(constants, "well", "left").withColumns(sizes)


def apply_baseline(base: DataFrame, baseline: DataFrame | None, profile: DataFrame, width: float) -> DataFrame:
    """Adds expected value, residual and scale per metric; a point without a bin keeps its raw value as residual."""
    rows = base.join(profile, "well")
    if baseline is None:
        empty = {f"{m}_{c}": F.lit(None).cast("double") for m in MODELLED for c in ("expected", "mad")}
        rows = rows.withColumns(empty)
    else:
        rows = rows.withColumn("_bin", freq_bin(FREQUENCY, width)).join(
            baseline_by_bin(baseline).withColumnRenamed("bin_index", "_bin"), "_bin", "left"
        )
    out = {}
    for metric, name in MODELLED.items():
        applies = F.col(f"{name}_fallback").isNotNull()
        expected = F.when(applies, F.col(f"{metric}_expected"))
        lowest = F.greatest(F.col(f"{name}_fallback") * 0.1, F.lit(0.05))
        out[name] = F.col(metric)
        out[f"{name}_expected"] = expected
        out[f"{name}_residual"] = F.coalesce(F.col(metric) - expected, F.col(metric))
        out[f"{name}_scale"] = F.when(applies, F.greatest(F.coalesce(f"{metric}_mad", f"{name}_fill"), lowest))
    out["frequency"] = F.col(FREQUENCY)
    rows = rows.withColumns(out)
    return rows.withColumns({f"{n}_z": safe_divide(f"{n}_residual", f"{n}_scale") for n in MODELLED.values()})


def rolling_mean(x: str, order: WindowSpec, w: int, mp: int, shift: int = 0) -> Column:
    """Mean of the ``w`` rows ending ``shift`` rows back; null with fewer than ``mp`` valid values."""
    frame = order.rowsBetween(-(w - 1 + shift), -shift)
    return F.when(F.count(x).over(frame) >= mp, F.avg(x).over(frame))


def lag_difference(x: str, order: WindowSpec, shift: int) -> Column:
    return F.col(x) - F.lag(x, shift).over(order)


def _trailing_mean(x: pd.Series, w: int, mp: int) -> np.ndarray:
    """Mean of the last ``w`` values, summed in their order; null with fewer than ``mp`` valid ones."""
    valid = x.notna().to_numpy()
    filled, n = np.where(valid, x.to_numpy(dtype=float, na_value=np.nan), 0.0), len(x)
    total, count = np.zeros(n), np.zeros(n, dtype=np.int64)
    for back in range(min(w, n) - 1, -1, -1):
        total[back:] += filled[: n - back]
        count[back:] += valid[: n - back]
    return np.where(count >= mp, total / np.maximum(count, 1), np.nan)


def _roll(names: Sequence[str]) -> Callable[[pd.DataFrame], None]:
    """Trailing mean, lagged trailing mean and lag difference with the well's own sizes."""

    def run(rows: pd.DataFrame) -> None:
        for n in names:
            x = rows[f"{n}_residual"]
            w, s, mp = (int(rows[f"{n}_{c}"].iloc[0]) for c in ("w", "s", "mp"))
            rows[f"_{n}_now"] = _trailing_mean(x, w, mp)
            rows[f"_{n}_before"] = rows[f"_{n}_now"].shift(s)
            if n == "pressure":
                rows["pressure_slope"] = x - x.shift(s)

    return run


def interpolate_time(us: str, v: str) -> Column:
    """Time-linear value between the nearest valid points, given as ``<us>_prev``, ``<v>_prev``, ``…_next``.

    After the last valid point its value holds; before the first one the result is null.
    """
    p, n = F.col(f"{v}_prev"), F.col(f"{v}_next")
    slope = (n - p) / (F.col(f"{us}_next") - F.col(f"{us}_prev"))
    between = slope * (micros("ts") - F.col(f"{us}_prev")) + p
    return F.coalesce(v, F.when(n.isNotNull(), between).otherwise(p))


def rolling_features(rows: DataFrame, names: Sequence[str] = tuple(MODELLED.values())) -> DataFrame:
    """Adds ``<n>_delta`` per metric and the pressure slope to rows with residuals and the well's window sizes."""
    reach = F.greatest(F.lit(1), *[F.col(f"{n}_w") + F.col(f"{n}_s") for n in names])
    added = [f"_{n}_{c}" for n in names for c in ("now", "before")] + ["pressure_slope"] * ("pressure" in names)
    blocks = on_blocks(with_halo(rows, back=reach), _roll(names), ", ".join(f"{c} double" for c in added))
    points = {f"_{n}_us": F.when(F.col(f"_{n}_before").isNotNull(), micros("ts")) for n in names}
    payloads = [f"_{n}_{c}" for n in names for c in ("us", "before")]
    around = neighbours(blocks.withColumns(points), ["well"], "_block", ["pos"], payloads)
    around = around.withColumns({f"_{n}_before": interpolate_time(f"_{n}_us", f"_{n}_before") for n in names})
    change = {n: F.col(f"_{n}_now") - F.col(f"_{n}_before") for n in names}
    return around.withColumns({f"{n}_delta": safe_divide(change[n], f"_{n}_before") for n in names})


def feature_frame(
    base: DataFrame,
    baseline: DataFrame | None,
    cfg: FeatureSettings = FeatureSettings(),
    bcfg: BaselineSettings = BaselineSettings(),
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(well, ts, pos, <20 features>)`` of every grid row; ``base`` and ``baseline`` should be staged.

    ``keep`` names base columns to carry along, which saves a later join back.
    """
    profile = stage(well_profile(base, baseline, cfg, bcfg), "profile")
    residuals = apply_baseline(base, baseline, profile, bcfg.bin_width)
    rows = rolling_features(residuals)
    return rows.select("well", "ts", "pos", *FEATURES, *keep)
