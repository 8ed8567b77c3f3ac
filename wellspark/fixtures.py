"""The ``events`` and ``lineitem`` tables read as telemetry and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.schema import (
    AlignSettings,
    BaselineSettings,
    CauseProfile,
    CauseRules,
    CleanSettings,
    DetectSettings,
    FeatureSettings,
    ResidualSettings,
)

WELLS = 10
METRIC_OF = {"view": "Intake_Pressure", "click": "Current", "purchase": "Motor_Temperature", "signup": "Frequency"}
CAUSES = ("tubing_leak", "inflow_drop", "inflow_rise", "normal_freq", "normal_freq")

RULES = CauseRules(
    anomaly=("tubing_leak", "inflow_drop", "inflow_rise"),
    normal=("normal_freq",),
    inflow_fragments=("inflow",),
    leak_fragments=("leak",),
    pinned_slope={"inflow": 0.03},
    profiles=(
        CauseProfile("tubing_leak", "leak"),
        CauseProfile("inflow_drop", "inflow"),
        CauseProfile("inflow_rise", "inflow"),
    ),
)

# The 15-minute defaults scaled by 24 to a six-hour grid.
SETTINGS = DetectSettings(
    align=AlignSettings(frequency="6h"),
    clean=CleanSettings(hampel_minutes=1080, n_sigma=3.0, fill_minutes=720),
    features=FeatureSettings(window_minutes=720, shift_minutes=360, min_samples=720),
    baseline=BaselineSettings(bin_width=20.0, min_points=10),
    residual=ResidualSettings(min_points=30),
    causes=RULES,
    gap_minutes=1440,
    holdout=("w3", "w7"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _well(user_id: str = "user_id", wells: int = WELLS) -> Column:
    return F.concat(F.lit("w"), (F.col(user_id) % wells).cast("string"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def telemetry(spark: SparkSession, sf_dir: str, wells: int = WELLS) -> DataFrame:
    """Sensor samples: four event types are four metrics."""
    names = F.create_map(*[F.lit(x) for pair in METRIC_OF.items() for x in pair])
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin(list(METRIC_OF)))
        .select(
            _well(wells=wells).alias("well"),
            names[F.col("event_type")].alias("metric"),
            "ts",
            "value",
            F.col("event_id").alias("row_id"),
        )
    )


def lineitem_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with many repeated timestamps."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("w"), (F.col("l_suppkey") % 10).cast("string")).alias("well"),
        F.col("l_returnflag").alias("metric"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.col("l_quantity").alias("value"),
        F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("row_id"),
    )


def annotations(spark: SparkSession, sf_dir: str, wells: int = WELLS) -> DataFrame:
    """One labelled day per error event."""
    causes = F.array(*[F.lit(c) for c in CAUSES])
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "error")
        .select(
            F.col("event_id").alias("row_id"),
            _well(wells=wells).alias("well"),
            F.get(causes, _k() % 5).alias("cause"),
            F.col("ts").alias("start_ts"),
            (F.col("ts") + F.expr("interval 24 hours")).alias("end_ts"),
            F.array(F.concat(F.lit("k="), _k().cast("string"))).alias("notes"),
        )
    )
