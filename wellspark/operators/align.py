"""Ragged sensor samples to one regular grid per well.

The raw table is scanned twice: once, column-pruned, for the sample range of
every (well, metric), and once for the bins. Everything later works on grid rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.functions.scalar import finite, floor_div, from_micros, micros
from wellspark.operators.ordering import positions
from wellspark.operators.quantiles import exact_quantiles
from wellspark.schema import DAY, METRICS, AlignSettings, frequency_micros
from wellspark.staging import stage

_SLICE_STEPS = 4096  # grid steps per slice when positions are numbered


def valid_samples(df: DataFrame) -> DataFrame:
    """Samples that have a well, a time and a usable value."""
    return df.withColumn("value", finite("value")).where(
        F.col("well").isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull()
    )


def dedup_last(df: DataFrame) -> DataFrame:
    """One value per (well, metric, ts): the one latest in row order."""
    return df.groupBy("well", "metric", "ts").agg(F.max_by("value", "row_id").alias("value"))


def metric_bounds(samples: DataFrame) -> DataFrame:
    """First and last sample time per (well, metric)."""
    return samples.groupBy("well", "metric").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def common_range(bounds: DataFrame) -> DataFrame:
    """Per well the span in which all its metrics report; wells without such a span are absent."""
    return (
        bounds.groupBy("well")
        .agg(F.max("first_ts").alias("range_start"), F.min("last_ts").alias("range_end"))
        .where(F.col("range_start") < F.col("range_end"))
    )


def clip_common_range(samples: DataFrame, ranges: DataFrame) -> DataFrame:
    """Samples inside their well's common range (closed), with the range attached."""
    return samples.join(ranges, "well").where(F.col("ts").between(F.col("range_start"), F.col("range_end")))


def aligned_samples(telemetry: DataFrame, wells: Sequence[str] | None = None) -> DataFrame:
    """Raw-rate series per (well, metric): valid, unique in time, clipped to the common range."""
    rows = telemetry if wells is None else telemetry.where(F.col("well").isin(list(wells)))
    rows = valid_samples(rows)
    ranges = stage(common_range(metric_bounds(rows)), "ranges")
    return dedup_last(clip_common_range(rows, ranges).select("well", "metric", "ts", "value", "row_id"))


def _with_origin(clipped: DataFrame, step: int) -> DataFrame:
    """Adds ``_origin``: microseconds the grid is anchored at."""
    if DAY % step == 0:
        return clipped.withColumn("_origin", F.lit(0).cast("bigint"))
    firsts = clipped.groupBy("well", "metric").agg(micros(F.date_trunc("day", F.min("ts"))).alias("_origin"))
    return clipped.join(stage(firsts, "origins"), ["well", "metric"])


def _aggregate(aggregation: str, value: Column) -> Column:
    return {"max": F.max, "min": F.min}.get((aggregation or "mean").lower(), F.avg)(value)


def resample(clipped: DataFrame, cfg: AlignSettings) -> DataFrame:
    """Long bins ``(well, metric, ts, value, min_value, max_value)``, labelled at their left edge.

    ``clipped`` carries ``range_start``/``range_end``; a bin is kept when its label lies in that range.
    Where it has a ``row_id``, of samples at the same time the one latest in row order counts. Samples are
    exchanged once, by bin: samples of the same time share a bin.
    Bins without samples are absent here; :func:`build_base` restores the ones the grid needs.
    """
    step = frequency_micros(cfg.frequency)
    rows = _with_origin(clipped, step)
    label = floor_div(micros("ts") - F.col("_origin"), step) * F.lit(step) + F.col("_origin")
    keys = ["well", "metric", "_label"]
    spans = [F.any_value(c).alias(c) for c in ("range_start", "range_end")]
    order = ["row_id"] if "row_id" in clipped.columns else []
    rows = rows.select("well", "metric", label.alias("_label"), "ts", "value", "range_start", "range_end", *order).repartition(*keys)
    if order:
        rows = rows.groupBy(*keys, "ts").agg(F.max_by("value", "row_id").alias("value"), *spans)
    median = (cfg.aggregation or "").lower() == "median"
    if median:
        rows = stage(rows, "bin-samples")
    bins = rows.groupBy(*keys).agg(
        _aggregate(cfg.aggregation, F.col("value")).alias("value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        *spans,
    )
    if median:
        medians = exact_quantiles(rows, keys, "value", {"value": 0.5}).drop("n")
        bins = bins.drop("value").join(medians, keys)
    columns = ["range_start", "range_end", from_micros("_label").alias("ts"), "value", "min_value", "max_value"]
    return bins.select("well", "metric", *columns)


def in_range(bins: DataFrame) -> DataFrame:
    return bins.where(F.col("ts").between(F.col("range_start"), F.col("range_end")))


def dense_labels(bins: DataFrame, metric: str, step: int) -> DataFrame:
    """Every grid label between a metric's first and last bin, per well."""
    width = step * _SLICE_STEPS
    spans = (
        bins.where(F.col("metric") == metric)
        .groupBy("well", "range_start", "range_end")
        .agg(F.min(micros("ts")).alias("_first"), F.max(micros("ts")).alias("_last"))
    )
    chunks = spans.withColumn(
        "_from", F.explode(F.sequence(F.col("_first"), F.col("_last"), F.lit(width).cast("bigint")))
    ).repartition("well", "_from")
    steps = F.sequence(
        F.col("_from"), F.least(F.col("_last"), F.col("_from") + F.lit(width - step)), F.lit(step).cast("bigint")
    )
    return chunks.select("well", "range_start", "range_end", F.explode(steps).alias("_us")).select(
        "well", "range_start", "range_end", from_micros("_us").alias("ts")
    )


def all_metrics(bounds: DataFrame) -> tuple[str, ...]:
    """The named metrics, then all others that report, by name."""
    found = {r["metric"] for r in bounds.select("metric").distinct().collect()}
    return (*METRICS, *sorted(found - {*METRICS, None}))


def base_metrics(base: DataFrame, cfg: AlignSettings) -> list[str]:
    """The metrics that a grid frame holds."""
    return [c for c in base.columns if c not in ("well", "ts", "pos", *extrema_columns(cfg))]


def extrema_columns(cfg: AlignSettings) -> list[str]:
    return [f"{m}_{side}" for m in cfg.extrema for side in ("min", "max")]


def pivot_metrics(long: DataFrame, cfg: AlignSettings, keys: Sequence[str] = ("well", "ts")) -> DataFrame:
    """Metrics side by side on time, in one shuffle for all of them."""
    columns = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in cfg.metrics]
    for m in cfg.extrema:
        for side in ("min", "max"):
            columns.append(F.max(F.when(F.col("metric") == m, F.col(f"{side}_value"))).alias(f"{m}_{side}"))
    return long.groupBy(*keys).agg(*columns)


def chosen(telemetry: DataFrame, cfg: AlignSettings) -> DataFrame:
    """Samples of the metrics that the settings name; all where they name none."""
    return telemetry if cfg.metrics is None else telemetry.where(F.col("metric").isin(list(cfg.metrics)))


def build_base(telemetry: DataFrame, cfg: AlignSettings = AlignSettings()) -> DataFrame:
    """The grid frame ``(well, ts, <metrics>, <extrema>, pos)`` of every well.

    Rows in which every metric is null survive only inside the span of an extrema metric.
    Without a frequency the samples pass through on their own times.
    Range and grid use the same metrics: those set, or else all that the telemetry has.
    """
    rows = valid_samples(chosen(telemetry, cfg)).where(F.col("metric").isNotNull())
    bounds = stage(metric_bounds(rows), "bounds")
    if cfg.metrics is None:
        cfg = replace(cfg, metrics=all_metrics(bounds))
    ranges = stage(common_range(bounds), "ranges")
    clipped = clip_common_range(rows, ranges)
    if not cfg.frequency:
        samples = dedup_last(clipped)
        raw = AlignSettings("", cfg.aggregation, cfg.metrics, ())
        wide = stage(pivot_metrics(samples, raw), "base-raw")
        return positions(wide, ["well"], "ts", DAY)
    step = frequency_micros(cfg.frequency)
    bins = stage(resample(clipped, cfg), "bins")
    skeleton = bins.select("well", "range_start", "range_end", "ts", "metric", "value", "min_value", "max_value")
    for metric in cfg.extrema:
        empty = dense_labels(bins, metric, step)
        skeleton = skeleton.unionByName(empty, allowMissingColumns=True)
    wide = pivot_metrics(in_range(skeleton), cfg)
    return positions(stage(wide, "grid"), ["well"], "ts", step * _SLICE_STEPS)


def pressure_fast(telemetry: DataFrame, cfg: AlignSettings = AlignSettings()) -> DataFrame:
    """Raw-rate pressure inside the common range: ``(well, ts, <extrema metrics>)``."""
    samples = aligned_samples(chosen(telemetry, cfg)).where(F.col("metric").isin(list(cfg.extrema)))
    columns = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in cfg.extrema]
    return samples.groupBy("well", "ts").agg(*columns)
