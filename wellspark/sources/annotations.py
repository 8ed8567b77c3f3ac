"""The annotation sheet: two leading rows, a header row, then intervals with free comments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.functions.scalar import coerce_ts
from wellspark.operators.intervals import ffill_annotations
from wellspark.sources.cells import read_cells  # noqa: F401 - part of this module's interface
from wellspark.staging import stage


@dataclass(frozen=True)
class AnnotationColumns:
    # fixed values: header names of the annotation sheet
    well: str = "Скв"
    cause: str = "ПричОст"
    start: str = "Время возникновения аномалии"
    end: str = "Время остановки скважины"
    comment_prefix: str = "Unnamed"


def _cell(name: str) -> Column:
    """The row's cell under the first header cell called ``name``; null where the column is absent."""
    at = F.array_position("header", F.lit(name)).cast("int")
    return F.when(at > 0, F.nullif(F.get("cells", at - 1), F.lit("")))


def parse_annotations(cells: DataFrame, columns: AnnotationColumns = AnnotationColumns(), skip: int = 2) -> DataFrame:
    """``(source_id, row_id, well, cause, start_ts, end_ts, notes)`` of the rows below the header.

    Unreadable times become null. Cells under a blank or ``Unnamed`` header are comments.
    Well and cause are not filled down yet; see :func:`read_annotations`.
    """
    blank = F.transform(
        "cells",
        lambda c, i: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.concat(F.lit(f"{columns.comment_prefix}: "), i.cast("string"))).otherwise(F.trim(c)),
    )
    header = stage(cells.where(F.col("row_id") == skip).select("source_id", blank.alias("header")), "headers")
    rows = cells.where(F.col("row_id") > skip).join(header, "source_id")
    comments = F.filter(F.arrays_zip("header", "cells"), lambda z: z["header"].startswith(columns.comment_prefix))
    texts = F.transform(comments, lambda z: F.trim(z["cells"]))
    return rows.select(
        "source_id",
        "row_id",
        _cell(columns.well).alias("well"),
        _cell(columns.cause).alias("cause"),
        coerce_ts(_cell(columns.start)).alias("start_ts"),
        coerce_ts(_cell(columns.end)).alias("end_ts"),
        F.filter(texts, lambda t: t.isNotNull() & (t != "")).alias("notes"),
    )


def read_annotations(cells: DataFrame, columns: AnnotationColumns = AnnotationColumns(), skip: int = 2) -> DataFrame:
    """Parsed annotations with well and cause filled down in sheet order."""
    return ffill_annotations(parse_annotations(cells, columns, skip))


def annotations_from_records(rows: DataFrame, sheet: str = "svod", columns: AnnotationColumns = AnnotationColumns(), source: str = "payload_id") -> DataFrame:
    """Annotations from ``(payload_id, sheet, row_no, record)`` rows of a JSON payload."""

    def cell(name: str) -> Column:
        return F.nullif(F.try_element_at("record", F.lit(name)), F.lit(""))

    notes = F.transform(
        F.filter(F.map_entries("record"), lambda e: e["key"].startswith(columns.comment_prefix)), lambda e: F.trim(e["value"])
    )
    parsed = rows.where(F.col("sheet") == sheet).select(
        F.col(source).alias("source_id"),
        F.col("row_no").alias("row_id"),
        cell(columns.well).alias("well"),
        cell(columns.cause).alias("cause"),
        coerce_ts(cell(columns.start)).alias("start_ts"),
        coerce_ts(cell(columns.end)).alias("end_ts"),
        F.filter(notes, lambda t: t.isNotNull() & (t != "")).alias("notes"),
    )
    return ffill_annotations(parsed)
