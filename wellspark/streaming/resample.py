"""Grid bins of a live telemetry stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.operators.align import valid_samples


def resample_stream(samples: DataFrame, frequency: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """Mean, minimum and maximum per (well, metric, bin), emitted once the watermark passes the bin.

    Samples later than ``lateness`` are dropped; of repeated timestamps the last row counts.
    """
    rows = valid_samples(samples).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    unique = rows.groupBy("well", "metric", "ts").agg(F.max_by("value", "row_id").alias("value"))
    bins = unique.groupBy("well", "metric", F.window("ts", frequency).alias("w")).agg(
        F.avg("value").alias("value"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )
    return bins.select("well", "metric", F.col("w.start").cast("timestamp_ntz").alias("ts"), "value", "min_value", "max_value")
