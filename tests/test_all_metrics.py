"""A metric that the settings do not name reaches grid and cleaning; one that they leave out does not narrow them."""

import pandas as pd
from pyspark.sql import functions as F

from tests.test_grid import random_samples, to_spark
from wellspark.operators import align
from wellspark.plans.prepare import Prepared
from wellspark.schema import METRICS, AlignSettings, DetectSettings

NOTES = "row_id long, well string, cause string, start_ts timestamp_ntz, end_ts timestamp_ntz, notes array<string>"


def five():
    pdf = random_samples(n=60)
    more = pdf[pdf.metric == "Current"].assign(metric="Vibration")
    more = more[more.ts < pd.Timestamp("2024-03-06")]
    more["row_id"] += len(pdf)
    return pdf, pd.concat([pdf, more], ignore_index=True)


def test_fifth_metric(spark):
    four, all_five = five()
    run = Prepared(to_spark(spark, all_five), spark.createDataFrame([], NOTES), DetectSettings(align=AlignSettings("1h")))
    assert run.raw_base.columns[2:7] == [*METRICS, "Vibration"]
    assert "Vibration" in run.base.columns and "Vibration_outlier" in run.flagged.columns
    extrema = {"Intake_Pressure_min", "Intake_Pressure_max"}
    assert not extrema & set(run.metrics) and extrema < set(run.base.columns)
    assert not {f"{c}_outlier" for c in extrema} & set(run.flagged.columns)
    # Extrema are cleared with their metric's outliers and are neither filtered nor filled of their own.
    joined = run.flagged.alias("a").join(run.raw_base.alias("b"), ["well", "ts"])
    for c in extrema:
        kept = F.when(~F.col("a.Intake_Pressure_outlier"), F.col(f"b.{c}"))
        assert joined.where(~F.col(f"a.{c}").eqNullSafe(kept)).isEmpty()
    same = run.raw_base.where(~F.col("Vibration").eqNullSafe(F.col("Current")) & F.col("Current").isNotNull())
    assert run.raw_base.where("Vibration IS NOT NULL").count() > 0 and same.where("ts < '2024-03-05'").count() == 0
    named = align.build_base(to_spark(spark, all_five), AlignSettings("1h", metrics=METRICS))
    without = align.build_base(to_spark(spark, four), AlignSettings("1h"))
    assert named.columns == without.columns and named.exceptAll(without).count() == without.exceptAll(named).count() == 0
    assert without.count() > run.raw_base.count()
