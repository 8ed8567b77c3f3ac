"""Wide sheets with one clock per metric, read as long samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.functions.scalar import canon_well, coerce_num, coerce_ts
from wellspark.sources.cells import read_records

PREFIX = "timestamp_"
ANNOTATION_SHEET = "svod"


def file_order() -> F.Column:
    """Sort key that follows the order of lines inside a file."""
    return F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_wide(spark: SparkSession, path: str, fmt: str = "csv", **options: str) -> DataFrame:
    """Well sheets for :func:`unpivot_telemetry`; the file name without extension is the well.

    CSV sheets may each have their own columns in their own order, so their rows come as
    ``(sheet, row_no, record)``. Other formats, which name their columns themselves, come as columns plus
    ``well`` and ``row_id``.
    """
    if fmt == "csv":
        return read_records(spark, path)
    rows = spark.read.format(fmt).options(**options).load(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return rows.select("*", F.url_decode(name).alias("well"), file_order().alias("row_id"))


def metric_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    """``(timestamp column, value column)`` pairs; a timestamp without a value column is ignored."""
    pairs = [(c, c.replace(PREFIX, "")) for c in columns if c.startswith(PREFIX)]
    return [(t, m) for t, m in pairs if m in columns]


def unpivot_telemetry(wide: DataFrame, annotation_sheet: str = ANNOTATION_SHEET) -> DataFrame:
    """Long samples ``(well, metric, ts, value, row_id)``; unreadable cells become null."""
    if "record" in wide.columns:
        return telemetry_from_records(wide, annotation_sheet)
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(f"`{t}`").cast("string").alias("ts"), F.col(f"`{m}`").cast("string").alias("value"))
            for t, m in metric_pairs(wide.columns)
        ]
    )
    rows = wide.where(F.col("well") != annotation_sheet).select("well", "row_id", F.inline(cells))
    present = rows.where(F.col("ts").isNotNull() | F.col("value").isNotNull())
    return present.select(canon_well("well").alias("well"), "metric", coerce_ts("ts").alias("ts"), coerce_num("value").alias("value"), "row_id")


def telemetry_from_records(rows: DataFrame, annotation_sheet: str = ANNOTATION_SHEET) -> DataFrame:
    """Long samples from ``(sheet, row_no, record)`` rows, where ``record`` maps column names to text."""
    data = rows.where(F.col("sheet") != annotation_sheet)
    cells = data.select(F.col("sheet").alias("well"), F.col("row_no").alias("row_id"), "record", F.explode("record").alias("key", "text"))
    stamped = cells.where(F.col("key").startswith(PREFIX)).withColumn("metric", F.replace("key", F.lit(PREFIX), F.lit("")))
    value = F.element_at("record", F.col("metric"))
    paired = stamped.where(F.map_contains_key("record", F.col("metric")) & (F.col("text").isNotNull() | value.isNotNull()))
    return paired.select(
        canon_well("well").alias("well"),
        "metric",
        coerce_ts("text").alias("ts"),
        coerce_num(F.element_at("record", F.col("metric"))).alias("value"),
        "row_id",
    )


def conformance_report(df: DataFrame, table: str, spec: Mapping[str, str]) -> DataFrame:
    """Per expected column: whether it is missing, values present and values that fail coercion.

    ``spec`` maps a column to ``timestamp``, ``double`` or ``string``. Reads the table once and stops nothing.
    """
    readers = {"timestamp": coerce_ts, "double": coerce_num, "string": lambda c: c}
    present = {c: kind for c, kind in spec.items() if c in df.columns}
    counted = []
    for c, kind in present.items():
        raw = F.col(f"`{c}`")
        counted += [F.count(raw).alias(f"{c}#n"), F.count_if(raw.isNotNull() & readers[kind](raw).isNull()).alias(f"{c}#bad")]
    totals = df.agg(*counted) if counted else df.limit(1).agg(F.count("*").alias("_"))
    lines = F.array(
        *[
            F.struct(
                F.lit(table).alias("table"),
                F.lit(c).alias("column"),
                F.lit(c not in present).alias("missing"),
                (F.col(f"`{c}#n`") if c in present else F.lit(0)).cast("bigint").alias("checked"),
                (F.col(f"`{c}#bad`") if c in present else F.lit(0)).cast("bigint").alias("failed"),
            )
            for c in spec
        ]
    )
    return totals.select(F.inline(lines))


def load_detections(spark: SparkSession, path: str, wells: Sequence[str] | None = None) -> DataFrame:
    """Written detections of the requested wells, anomaly segments only; both filters reach the scan."""
    rows = spark.read.parquet(path).where(F.col("segment_type") == "anomaly")
    rows = rows.withColumn("well", F.col("well").cast("string"))
    return rows if wells is None else rows.where(F.col("well").isin(list(wells)))
