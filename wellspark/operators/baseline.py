"""Frequency-binned robust baseline: what each metric normally reads at a drive frequency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wellspark.functions.scalar import bin_center, freq_bin
from wellspark.operators.intervals import bucketed_coverage, weigh_points
from wellspark.operators.quantiles import exact_quantiles
from wellspark.schema import FREQUENCY, MODELLED, BaselineSettings
from wellspark.staging import stage, together

_SIGMA = 1.4826
_TINY = 1e-6


def unpivot(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``(keys, metric, value)`` rows of the non-null metric columns."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    return (
        wide.select(*keys, cells.alias("_cell"))
        .select(*keys, "_cell.metric", "_cell.value")
        .where(F.col("value").isNotNull())
    )


def median_and_spread(
    rows: DataFrame, keys: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """``(keys, n, median, spread)``: exact median and median absolute deviation per key."""
    medians = stage(exact_quantiles(rows, keys, value, {"median": 0.5}, weight), "medians")
    away = rows.join(medians.select(*keys, "median"), list(keys)).withColumn("_away", F.abs(F.col(value) - F.col("median")))
    spreads = exact_quantiles(away, keys, "_away", {"spread": 0.5}, weight).drop("n")
    return medians.join(spreads, list(keys))


def build_baseline(
    base: DataFrame, normal: DataFrame, cfg: BaselineSettings = BaselineSettings()
) -> DataFrame:
    """Robust centre and spread per (metric, frequency bin) over the normal intervals.

    A grid point counts once for each interval that holds it. Bins with fewer than
    ``min_points`` points are left out; without a bin width the baseline is empty.
    """
    width = cfg.bin_width if cfg.enabled else 0
    segments = bucketed_coverage(normal)
    inside = weigh_points(base.where(F.col(FREQUENCY).isNotNull() & F.lit(width > 0)), segments)
    inside = inside.withColumn("bin_index", freq_bin(FREQUENCY, width or 1.0)).where(F.col("bin_index").isNotNull())
    points = unpivot(inside, ["bin_index", "weight"], cfg.metrics)
    points = stage(points, "baseline-points")
    keys = ["metric", "bin_index"]
    stats = median_and_spread(points, keys, "value", "weight").where(F.col("n") >= cfg.min_points)
    mad = F.col("spread") * _SIGMA
    return stats.select(
        "metric",
        "bin_index",
        bin_center("bin_index", width).alias("frequency_center"),
        F.col("n").alias("count"),
        "median",
        F.when(mad > 0, mad).otherwise(_TINY).alias("mad"),
    )


def baseline_by_bin(baseline: DataFrame, metrics: Sequence[str] = tuple(MODELLED)) -> DataFrame:
    """One row per bin: ``(bin_index, <m>_expected, <m>_mad)``."""
    columns = []
    for m in metrics:
        own = F.col("metric") == m
        columns += [F.max(F.when(own, F.col("median"))).alias(f"{m}_expected"), F.max(F.when(own, F.col("mad"))).alias(f"{m}_mad")]
    return baseline.groupBy("bin_index").agg(*columns)


def scale_profile(
    base: DataFrame, baseline: DataFrame, width: float, metrics: Sequence[str] = tuple(MODELLED)
) -> DataFrame:
    """Scale to use where a well's metric has no bin: ``(well, metric, fallback, fill)``.

    Rows exist only where the baseline applies: the well reports a frequency and the
    metric, and the metric has at least one bin.
    """
    values = unpivot(base, ["well"], metrics)
    deviation = values.groupBy("well", "metric").agg(F.stddev_pop("value").alias("deviation"))
    at_bin = base.where(F.col(FREQUENCY).isNotNull()).groupBy("well", freq_bin(FREQUENCY, width).alias("bin_index"))
    scales = at_bin.agg(F.count("*").alias("_rows")).join(baseline.select("metric", "bin_index", "mad"), "bin_index")
    spread, found = together(
        base.sparkSession,
        lambda: median_and_spread(values, ["well", "metric"], "value").select("well", "metric", "spread"),
        lambda: exact_quantiles(scales, ["well", "metric"], "mad", {"found": 0.5}, "_rows").select("well", "metric", "found"),
    )
    raw = F.when(F.col("spread") > 0, F.col("spread")).when(F.col("deviation") > 0, F.col("deviation")).otherwise(1.0)
    fallback = spread.join(deviation, ["well", "metric"]).select("well", "metric", (raw * _SIGMA).alias("fallback"))

    with_frequency = base.where(F.col(FREQUENCY).isNotNull()).select("well").distinct()
    known = baseline.select("metric").distinct()
    return (
        fallback.join(with_frequency, "well", "left_semi")
        .join(known, "metric", "left_semi")
        .join(found, ["well", "metric"], "left")
        .select(
            "well",
            "metric",
            "fallback",
            F.when(F.col("found") > 0, F.col("found")).otherwise(F.col("fallback")).alias("fill"),
        )
    )
