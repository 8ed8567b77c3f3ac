"""JSON workbooks: one document holds named sheets of records, in any of four shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHEET = "array<struct<name:string,records:variant>>"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as ``(payload_id, value)``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("payload_id"), "value")


def _get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def _as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _described(sheets: Column, name_key: str, records_key: str) -> Column:
    """A list of ``{name, records}`` objects as sheets."""

    def one(s: Column) -> Column:
        name = F.nullif(_get(s, name_key, "string"), F.lit(""))
        checked = F.when(_as_object(s).isNull(), F.raise_error(F.lit("a sheet description must be an object"))).otherwise(
            F.coalesce(name, F.raise_error(F.lit(f"a sheet description has no '{name_key}'")).cast("string"))
        )
        return F.struct(checked.alias("name"), _get(s, records_key).alias("records"))

    return F.transform(sheets, one)


def _rows(records: Column) -> Column:
    """Records as text maps: a list of row objects, or an object of columns keyed by row or in row order."""
    listed = F.transform(_as_list(records), lambda r: F.try_variant_get(r, "$", "map<string,string>"))
    columns = F.transform(
        F.map_entries(_as_object(records)),
        lambda c: F.struct(
            c["key"].alias("name"),
            F.coalesce(
                F.try_variant_get(c["value"], "$", "map<string,string>"),
                F.map_from_entries(
                    F.transform(
                        F.try_variant_get(c["value"], "$", "array<string>"), lambda x, i: F.struct(i.cast("string").alias("k"), x.alias("v"))
                    )
                ),
            ).alias("cells"),
        ),
    )
    found = F.array_distinct(F.flatten(F.transform(columns, lambda c: F.map_keys(c["cells"]))))
    # an object's members come in text order; row numbers must come in number order
    ranked = F.array_sort(F.transform(found, lambda k: F.struct(k.try_cast("bigint").alias("n"), k.alias("k"))))
    labels = F.transform(ranked, lambda r: r["k"])
    turned = F.transform(
        labels,
        lambda i: F.map_from_entries(
            F.transform(columns, lambda c: F.struct(c["name"].alias("k"), F.try_element_at(c["cells"], i).alias("v")))
        ),
    )
    return F.coalesce(listed, turned)


def sheets_from_json(
    payloads: DataFrame,
    sheets_key: str = "sheets",
    name_key: str = "name",
    records_key: str = "records",
    payload_path: str | Sequence[str] | None = None,
) -> DataFrame:
    """``(payload_id, sheet, row_no, record)`` of every record in every sheet.

    Accepted shapes, tried in order: an object with a list of described sheets under
    ``sheets_key``; an object of name to row list; an object of name to columns; a bare
    list of described sheets. Anything else, a nameless sheet or a document without
    sheets fails the query.
    """
    path = [payload_path] if isinstance(payload_path, str) else list(payload_path or [])
    doc = F.parse_json("value")
    for key in path:
        doc = _get(doc, key)
    rows = payloads.select("payload_id", doc.alias("doc"))
    doc = F.col("doc")
    members = _as_object(doc)
    named = F.transform(F.map_entries(members), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("records")))
    every_list = F.forall(F.map_values(members), lambda v: _as_list(v).isNotNull())
    every_object = F.forall(F.map_values(members), lambda v: _as_object(v).isNotNull())
    shape = (
        F.when(_as_list(_get(doc, sheets_key)).isNotNull(), _described(_as_list(_get(doc, sheets_key)), name_key, records_key))
        .when(every_list | every_object, named)
        .when(_as_list(doc).isNotNull(), _described(_as_list(doc), name_key, records_key))
        .otherwise(F.raise_error(F.lit("unsupported payload structure")).cast(_SHEET))
    )
    found = rows.select("payload_id", shape.alias("sheets"))
    filled = F.when(F.size("sheets") > 0, F.col("sheets")).otherwise(
        F.raise_error(F.lit("the payload holds no sheets")).cast(_SHEET)
    )
    sheets = found.select("payload_id", F.inline(filled))
    return sheets.select("payload_id", F.col("name").alias("sheet"), F.posexplode(_rows(F.col("records"))).alias("row_no", "record"))
