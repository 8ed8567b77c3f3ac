"""Robust outlier removal and bounded filling on the grid."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from wellspark.operators.ordering import on_blocks, sampling_gaps, with_halo
from wellspark.operators.quantiles import exact_quantiles
from wellspark.schema import DAY, METRICS, PRESSURE, CleanSettings
from wellspark.staging import stage

_SIGMA = 1.4826  # scales a median absolute deviation to a standard deviation


def sampling_step(
    rows: DataFrame, keys: Sequence[str], ts: str = "ts", width_us: int = 64 * DAY
) -> DataFrame:
    """Median gap in seconds per key: ``(keys, step)``; keys with fewer than two samples are absent."""
    gaps = sampling_gaps(rows, keys, ts, width_us)
    steps = exact_quantiles(gaps, keys, "gap", {"step": 0.5})
    return steps.select(*keys, F.when(F.col("step") > 0, F.col("step")).otherwise(60.0).alias("step"))


def whole_points(minutes: float, step) -> Column:
    """Minutes as a whole number of steps, halves to even."""
    return F.bround(F.lit(float(minutes)) * 60.0 / F.col(step)).cast("int")


def clean_params(base: DataFrame, cfg: CleanSettings) -> DataFrame:
    """Per well: half-width of the outlier frame and fill limit in rows: ``(well, half, fill)``."""
    wells = base.groupBy("well").agg(F.count("*").alias("_rows"))
    known = sampling_step(base, ["well"])
    steps = wells.join(known, "well", "left").withColumn("step", F.coalesce("step", F.lit(60.0)))
    points = F.greatest(whole_points(cfg.hampel_minutes, "step"), F.lit(3))
    half = F.floor(points / 2).cast("int")  # an even count is widened to the next odd one
    return steps.select("well", half.alias("half"), F.greatest(whole_points(cfg.fill_minutes, "step"), F.lit(0)).alias("fill"))


def _flag_and_fill(metrics: Sequence[str], extrema: Sequence[str], n_sigma: float) -> Callable[[pd.DataFrame], None]:
    def run(rows: pd.DataFrame) -> None:
        frame, fill = 2 * int(rows["half"].iloc[0]) + 1, int(rows["fill"].iloc[0])
        for m in metrics:
            rolling = {"window": frame, "center": True, "min_periods": 1}
            away = (rows[m] - rows[m].rolling(**rolling).median()).abs()
            outlier = away > n_sigma * _SIGMA * away.rolling(**rolling).median()
            rows[f"{m}_outlier"] = outlier
            rows[m] = rows[m].mask(outlier)
            if m == PRESSURE:
                for c in extrema:
                    rows[c] = rows[c].mask(outlier)
            empty = rows[m].isna()
            if fill:
                rows[m] = rows[m].ffill(limit=fill)
            rows[f"{m}_filled"] = empty & rows[m].notna()

    return run


def clean(
    base: DataFrame, cfg: CleanSettings = CleanSettings(), metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Outliers nulled, then short gaps filled forward; adds ``<m>_outlier`` and ``<m>_filled`` flags.

    A point is an outlier when it is further from the median of its centred frame than
    ``n_sigma`` scaled medians of such distances. A pressure outlier also clears the bin's extrema.
    Each well has its own frame size and fill limit; the rolling medians run on blocks of its rows.
    """
    if not cfg.active:
        flags = [F.lit(False).alias(f"{m}_{kind}") for m in metrics for kind in ("outlier", "filled")]
        return base.select("*", *flags)
    params = stage(clean_params(base, cfg), "clean-params")
    half, fill = F.col("half"), F.col("fill")
    rows = with_halo(base.join(params, "well"), back=2 * half + fill, ahead=2 * half)
    extrema = [c for c in (f"{PRESSURE}_min", f"{PRESSURE}_max") if c in base.columns]
    flags = [f"{m}_{kind}" for m in metrics for kind in ("outlier", "filled")]
    done = on_blocks(rows, _flag_and_fill(metrics, extrema, cfg.n_sigma), ", ".join(f"{c} boolean" for c in flags))
    return done.select(*base.columns, *[f"{m}_outlier" for m in metrics], *[f"{m}_filled" for m in metrics])


def ffill_limit(x: str, order: WindowSpec, limit: int) -> Column:
    """The last valid value at most ``limit`` rows back."""
    return F.last(x, ignorenulls=True).over(order.rowsBetween(-limit, 0)) if limit else F.col(x)


def cleaning_summary(cleaned: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Removed and filled values per (well, metric); metrics without either are absent."""
    per_metric = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("metric"),
                    F.col(f"{m}_outlier").cast("int").alias("removed"),
                    F.col(f"{m}_filled").cast("int").alias("filled"),
                )
                for m in metrics
            ]
        )
    ).alias("s")
    return (
        cleaned.select("well", per_metric)
        .groupBy("well", F.col("s.metric").alias("metric"))
        .agg(F.sum("s.removed").alias("removed_outliers"), F.sum("s.filled").alias("ffill_values"))
        .where((F.col("removed_outliers") > 0) | (F.col("ffill_values") > 0))
    )


def cleaning_totals(summary: DataFrame) -> DataFrame:
    return summary.groupBy("well").agg(
        F.sum("removed_outliers").alias("removed"), F.sum("ffill_values").alias("ffilled")
    )
