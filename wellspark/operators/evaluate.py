"""First trigger per labelled interval, and quality of the detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.functions.scalar import base_signal, minutes_between
from wellspark.operators.ordering import neighbours, time_slice
from wellspark.schema import DAY, FeatureSettings

_DELTAS = ("pressure_delta", "pressure_slope", "current_delta", "temperature_delta")


def first_triggers(
    features: DataFrame, intervals: DataFrame, rules: DataFrame, cfg: FeatureSettings
) -> DataFrame:
    """One row per interval: grid points looked at and the first point inside it with a base signal.

    The look-back before the interval start is the longer of window and shift. Points and three places of every
    interval - look-back, start and end - are swept together: the next signal from the start on is the only one
    that can be the first inside, and the number of points follows from the positions next to the other two.
    """
    warm = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(max(cfg.window_minutes, cfg.shift_minutes) * 60)))
    marked = features.select("well", "ts", "pos", *_DELTAS).join(rules.select("well", "thr_delta", "thr_slope"), "well", "left")
    signal = base_signal("pressure_delta", "pressure_slope", "thr_delta", "thr_slope")
    points = marked.select("well", "ts", F.lit(1).alias("_kind"), "pos", F.when(signal, F.struct("ts", *_DELTAS)).alias("signal"))
    spans = intervals.select("interval_id", "well", "start_ts", "end_ts")
    # Kinds order rows of one time: a look-back or start sees its own time ahead, an end sees it behind.
    places = [(F.col("start_ts") - warm, 0, "warm"), (F.col("start_ts"), 0, "start"), (F.col("end_ts"), 2, "end")]
    place = F.inline(F.array(*[F.struct(ts.alias("ts"), F.lit(kind).alias("_kind"), F.lit(name).alias("_place")) for ts, kind, name in places]))
    both = points.unionByName(spans.select("interval_id", "well", place), allowMissingColumns=True)
    both = both.withColumn("_slice", time_slice("ts", 64 * DAY))
    around = neighbours(both, ["well"], "_slice", ["ts", "_kind"], ["pos", "signal"]).where("_place IS NOT NULL")

    def at(name: str, column: str):
        return F.max(F.when(F.col("_place") == name, F.col(column)))

    seen = around.groupBy("interval_id").agg(
        at("start", "signal_next").alias("_next"), F.greatest(F.lit(0).cast("bigint"), at("end", "pos_prev") - at("warm", "pos_next") + 1).alias("evaluated_points")
    )
    spans = spans.join(seen, "interval_id", "left").withColumn("_hit", F.when(F.col("_next.ts") <= F.col("end_ts"), F.col("_next")))
    found = F.col("_hit.ts")
    trigger = F.struct(
        F.col("_hit.pressure_delta").alias("pressure_delta"),
        F.col("_hit.pressure_slope").alias("pressure_slope"),
        F.lit(False).alias("residual"),
        F.lit(False).alias("ewma"),
        F.lit(False).alias("spike"),
        F.col("_hit.current_delta").alias("current_delta"),
        F.col("_hit.temperature_delta").alias("temperature_delta"),
        F.lit(0.0).alias("notification_lag_minutes"),
    )
    delay = minutes_between(found, F.col("start_ts"))
    return spans.select(
        "well",
        F.col("start_ts").alias("interval_start"),
        F.col("end_ts").alias("interval_end"),
        found.alias("detection_start"),
        found.alias("aligned_detection_start"),
        found.alias("notification_time"),
        F.coalesce("evaluated_points", F.lit(0)).alias("evaluated_points"),
        delay.alias("delay_minutes"),
        delay.alias("aligned_delay_minutes"),
        F.when(found.isNotNull(), trigger).alias("triggers"),
        "interval_id",
    )


def describe_triggers(triggers: str = "triggers") -> Column:
    """Readable list of what fired, a dash when nothing did."""
    # fixed values: labels of the parts, in order
    parts = [
        F.when(F.col(f"{triggers}.{c}").isNotNull(), F.format_string(f"{name}=%.3f", F.col(f"{triggers}.{c}")))
        for c, name in zip(_DELTAS, ("ΔP", "slope", "ΔI", "ΔT"))
    ]
    parts += [F.when(F.col(f"{triggers}.{c}"), F.lit(c)) for c in ("residual", "ewma", "spike")]
    lag = F.col(f"{triggers}.notification_lag_minutes")
    parts.append(F.when(lag.isNotNull(), F.format_string("lag=%.1f мин", lag)))
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("—"))


def calibration_values(triggers: DataFrame, groups: DataFrame) -> DataFrame:
    """Trigger delta and slope of each training interval with both: ``(cause_group, well, interval_start, …)``."""
    rows = triggers.join(groups.select("interval_id", "cause_group"), "interval_id")
    return rows.where(
        F.col("triggers.pressure_delta").isNotNull() & F.col("triggers.pressure_slope").isNotNull()
    ).select("cause_group", "well", "interval_start", "triggers.pressure_delta", "triggers.pressure_slope")


def quality(records: DataFrame, refs: DataFrame) -> DataFrame:
    """Recall, precision, mean delay and missed references over one table each of detections and references."""
    spans = refs.select("well", F.col("start_ts").alias("reference_start"), "end_ts").distinct()
    found = records.select("well", "reference_start", "start").join(spans, ["well", "reference_start"], "left")
    per_ref = found.groupBy("well", "reference_start").agg(
        F.count("*").alias("hits"),
        F.sum((F.col("start").between(F.col("reference_start"), F.col("end_ts"))).cast("int")).alias("inside"),
        F.sum(minutes_between("start", "reference_start")).alias("delay"),
    )
    rows = spans.join(per_ref, ["well", "reference_start"], "left").agg(
        F.count("*").alias("reference_count"),
        F.count("hits").alias("matched"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("detections"),
        F.coalesce(F.sum("inside"), F.lit(0)).alias("inside"),
        F.sum("delay").alias("delay"),
    )
    return rows.select(
        "reference_count",
        "detections",
        (F.col("reference_count") - F.col("matched")).alias("missed"),
        F.try_divide(F.col("matched").cast("double"), F.col("reference_count")).alias("recall"),
        F.try_divide(F.col("inside").cast("double"), F.col("detections")).alias("precision"),
        F.try_divide(F.col("delay"), F.col("detections")).alias("mean_delay_minutes"),
    )
