"""Report tables. Every part is written by executors as a folder of files."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.functions.scalar import finite
from wellspark.schema import DetectSettings

_ISO = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def write_parquet(df: DataFrame, path: str) -> DataFrame:
    """Writes the rows once; other formats are made from the scan returned."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_both(df: DataFrame, path: str) -> None:
    """The same rows as parquet and as CSV with a header, computed once."""
    written = write_parquet(df, f"{path}.parquet")
    written.write.mode("overwrite").option("header", True).option("timestampNTZFormat", _ISO).csv(f"{path}.csv")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with ISO times; NaN and infinities are written as null fields."""
    clean = df.select(*[finite(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    writer = clean.write.mode("overwrite").option("ignoreNullFields", False)
    writer.option("timestampNTZFormat", _ISO).json(path)


def write_timeseries(base: DataFrame, folder: str) -> None:
    names = [c for c in base.columns if c not in ("well", "ts", "pos")]
    write_both(base.select("well", F.col("ts").alias("timestamp"), *names), f"{folder}/timeseries_15min")


def write_pressure_fast(fast: DataFrame, folder: str) -> None:
    names = [c for c in fast.columns if c not in ("well", "ts")]
    write_both(fast.select("well", F.col("ts").alias("timestamp"), *names), f"{folder}/pressure_fast")


def write_baseline(baseline: DataFrame, folder: str) -> None:
    write_both(baseline.orderBy("metric", "frequency_center"), f"{folder}/frequency_baseline")


def write_detections(records: DataFrame, folder: str) -> None:
    written = write_parquet(records.orderBy("start", "well", "segment_type"), f"{folder}/anomaly_analysis.parquet")
    write_json(written.orderBy("start", "well", "segment_type"), f"{folder}/anomaly_analysis.json")


def settings_rows(cfg: DetectSettings) -> list[tuple[str, str, str]]:
    rows = []
    for section, value in asdict(cfg).items():
        items = value.items() if isinstance(value, dict) else [("", value)]
        rows += [(section, str(name), str(v)) for name, v in items]
    return rows


def settings_table(spark: SparkSession, cfg: DetectSettings) -> DataFrame:
    """The settings of a run as ``(section, setting, value)`` rows."""
    return spark.createDataFrame(settings_rows(cfg), "section string, setting string, value string")


def write_run_summary(thresholds: DataFrame, training: DataFrame, records: DataFrame, cfg: DetectSettings, folder: str) -> None:
    """Thresholds, training summary, settings and detections of a run, one folder each."""
    write_json(thresholds.drop("first_row"), f"{folder}/summary/thresholds")
    write_json(training, f"{folder}/summary/training")
    write_json(settings_table(records.sparkSession, cfg), f"{folder}/summary/settings")
    write_json(records.orderBy("start", "well", "segment_type"), f"{folder}/summary/detections")


def write_reference(stats: DataFrame, summary: DataFrame, folder: str) -> None:
    write_both(stats, f"{folder}/events_features")
    write_json(summary, f"{folder}/events_summary")
