"""Interval statistics, label summaries and training summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.functions.scalar import direction, minutes_between, notes_text
from wellspark.operators.baseline import unpivot
from wellspark.operators.intervals import map_groups, point_spans, points_in_intervals, train_or_all
from wellspark.operators.quantiles import exact_quantiles
from wellspark.operators.thresholds import pool_features
from wellspark.schema import CauseRules, Directions
from wellspark.staging import stage

_DELTAS = ("pressure_delta", "current_delta", "temperature_delta")
SUMMARY_COLUMNS = (
    "pressure_mean", "pressure_delta_median", "pressure_min_15m", "pressure_max_15m",
    "current_mean", "current_delta_median", "temperature_mean", "temperature_delta_median",
)


def interval_stats(
    features: DataFrame, intervals: DataFrame, cfg: Directions = Directions()
) -> DataFrame:
    """Statistics of each interval that holds grid points (24 columns).

    ``features`` carries the pressure extrema of the grid besides the feature columns, where there are any. Intervals
    that hold the same points share their statistics (:func:`point_spans`), which are computed once.
    """
    p, c, t = "pressure", "current", "temperature"
    extrema = [f"Intake_Pressure_{side}" for side in ("min", "max")]
    missing = {x: F.lit(None).cast("double") for x in extrema if x not in features.columns}
    points = features.withColumns(missing).select("well", "ts", p, c, t, "frequency", *_DELTAS, *extrema)
    spanned = stage(point_spans(intervals, points), "interval-spans")
    spans = spanned.groupBy("span").agg(F.first("well").alias("well"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    pairs = points_in_intervals(points, spans)
    pairs = stage(pairs.select("span", p, c, t, "frequency", *_DELTAS, *extrema), "interval-points")
    stats = pairs.groupBy("span").agg(
        F.avg(p).alias("pressure_mean"),
        F.stddev_pop(p).alias("pressure_std"),
        F.min(p).alias("pressure_min"),
        F.max(p).alias("pressure_max"),
        F.min(extrema[0]).alias("pressure_min_15m"),
        F.max(extrema[1]).alias("pressure_max_15m"),
        F.avg("pressure_delta").alias("pressure_delta_mean"),
        F.avg(c).alias("current_mean"),
        F.stddev_pop(c).alias("current_std"),
        F.avg(t).alias("temperature_mean"),
        F.stddev_pop(t).alias("temperature_std"),
        F.avg("frequency").alias("frequency_mean"),
    )
    deltas = unpivot(pairs, ["span"], _DELTAS)
    middle = exact_quantiles(deltas, ["span", "metric"], "value", {"median": 0.5})
    medians = middle.groupBy("span").agg(
        *[F.max(F.when(F.col("metric") == d, F.col("median"))).alias(f"{d}_median") for d in _DELTAS]
    )
    rows = spanned.join(stage(stats.join(medians, "span", "left"), "span-stats"), "span")
    return rows.select(
        "well",
        "label",
        F.col("start_ts").alias("start"),
        F.col("end_ts").alias("end"),
        minutes_between("end_ts", "start_ts").alias("duration_minutes"),
        "pressure_mean",
        "pressure_std",
        "pressure_min",
        "pressure_max",
        "pressure_min_15m",
        "pressure_max_15m",
        "pressure_delta_median",
        "pressure_delta_mean",
        direction("pressure_delta_median", cfg).alias("pressure_direction"),
        "current_mean",
        "current_std",
        "current_delta_median",
        direction("current_delta_median", cfg).alias("current_direction"),
        "temperature_mean",
        "temperature_std",
        "temperature_delta_median",
        direction("temperature_delta_median", cfg).alias("temperature_direction"),
        "frequency_mean",
        notes_text("notes").alias("notes"),
    )


def percentile_name(p: float) -> str:
    return f"p{int(p * 100)}"


def label_summary(
    stats: DataFrame, percentiles: Sequence[float] = (0.1, 0.5, 0.9)
) -> DataFrame:
    """Per label and column: count, mean, population std, min, max and percentiles; empty columns are absent."""
    rows = unpivot(stats, ["label"], SUMMARY_COLUMNS).withColumnRenamed("metric", "column")
    keys = ["label", "column"]
    plain = rows.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    ranks = exact_quantiles(rows, keys, "value", {percentile_name(p): p for p in percentiles}).drop("n")
    return plain.join(ranks, keys)


_NORMAL = "\u0002"  # stands for normal operation among the cause groups, whatever these are called


def training_summary(
    features: DataFrame, intervals: DataFrame, rules: CauseRules, holdout: Sequence[str]
) -> DataFrame:
    """Per cause group: pooled points, wells used and causes seen; one more row, group null, for normal operation.

    Wells and causes come as rows of the lists they are members of: ``(cause_group, item, name, points)``.
    """
    anomalies = map_groups(intervals.where(F.col("label") == "anomaly"), rules)
    trained = train_or_all(anomalies, holdout, ["cause_group"])
    normal = train_or_all(intervals.where(F.col("label") == "normal"), holdout).withColumn("cause_group", F.lit(_NORMAL))
    used = trained.unionByName(normal)
    tagged = used.withColumn("well_group", F.struct("cause_group", "well"))
    wells = tagged.select("cause_group", F.lit("well").alias("item"), F.col("well").alias("name")).distinct()
    causes = anomalies.select("cause_group", F.lit("cause").alias("item"), F.col("cause").alias("name")).distinct()
    members = wells.unionByName(causes)
    points = group_points(features, used)
    return members.join(points, "cause_group", "left").select(
        F.when(F.col("cause_group") != _NORMAL, F.col("cause_group")).alias("cause_group"), "item", "name", F.coalesce("points", F.lit(0)).alias("points")
    )


def group_points(features: DataFrame, intervals: DataFrame) -> DataFrame:
    """Pooled pressure-delta values per cause group, a point counting once per interval that holds it."""
    keyed = intervals.withColumn("well", F.concat_ws("\u0001", "cause_group", "well"))
    groups = intervals.select("cause_group", "well").distinct()
    rows = features.join(groups, "well").withColumn("well", F.concat_ws("\u0001", "cause_group", "well"))
    pooled = pool_features(rows, keyed).where(F.col("feature") == "pressure_delta")
    named = pooled.withColumn("cause_group", F.substring_index("well", "\u0001", 1))
    return named.groupBy("cause_group").agg(F.sum("weight").alias("points"))
