"""CSV sheets as rows of cells: any number of columns, every file with its own header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wellspark.operators.ordering import neighbours, number_rows
from wellspark.staging import stage

# A cell and the comma after it: in quotes, with doubled ones inside, or up to the next comma. Read in one pass.
_CELL = '("[^"]*+(?:""[^"]*+)*+"(?=,)|[^,]*+),'


def split_cells(record: Column) -> Column:
    """Cells of one CSV record; quotes around a cell go and doubled ones inside it become single. Empty is null."""

    def bare(cell: Column) -> Column:
        quoted = F.length(cell).__ge__(2) & F.startswith(cell, F.lit('"')) & F.endswith(cell, F.lit('"'))
        inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
        return F.nullif(F.when(quoted, inner).otherwise(cell), F.lit(""))

    return F.transform(F.regexp_extract_all(F.concat(F.rtrim(record, F.lit("\r")), F.lit(",")), F.lit(_CELL), F.lit(1)), bare)


def _records(lines: DataFrame) -> DataFrame:
    """Lines ``(source_id, _block, _line, value)`` to records in the same columns: a record goes on while its quotes are odd.

    Quotes are counted inside the blocks of a file and carried from block to block; only lines of records with several
    lines are gathered.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.withColumn("_quotes", quotes)
    inside = Window.partitionBy("source_id", "_block").orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy("source_id", "_block").agg(F.sum("_quotes").alias("_all"))
    blocks = blocks.select("source_id", "_block", F.coalesce(F.sum("_all").over(across), F.lit(0)).alias("_carried"))
    met = counted.withColumn("_before", F.coalesce(F.sum("_quotes").over(inside), F.lit(0))).join(blocks, ["source_id", "_block"])
    goes_on = (F.col("_before") + F.col("_carried")) % 2 == 1
    met = met.select(*lines.columns, goes_on.alias("_goes_on"), (goes_on | (F.col("_quotes") % 2 == 1)).alias("_several"))
    head = F.when(~F.col("_goes_on"), F.struct("_block", "_line"))
    parts = neighbours(met.where("_several").withColumn("_head", head), ["source_id"], "_block", ["_line"], ["_head"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_block", "_line", "value"))), lambda x: x["value"]), "\n")
    joined = parts.groupBy("source_id", "_head_prev").agg(text.alias("value"))
    joined = joined.select("source_id", "_head_prev._block", "_head_prev._line", "value")
    return met.where("NOT _several").select(*lines.columns).unionByName(joined)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV sheets as ``(source_id, row_id, cells)``, records numbered from 0 in file order.

    A cell in quotes may hold line breaks. Blank lines are records too, so row numbers count them.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    )
    rows = _records(stage(lines, "lines"))
    numbered = number_rows(rows, ["source_id"], ["_block", "_line"], F.col("_block"), "_nth")
    return numbered.select("source_id", (F.col("_nth") - 1).alias("row_id"), split_cells(F.col("value")).alias("cells"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV sheets as ``(sheet, row_no, record)``: the file name without extension, and a map from the file's own
    header cells to the row's cells. Of equal header cells the first counts; cells past the header are left out.
    """
    cells = read_cells(spark, path)
    header = stage(cells.where(F.col("row_id") == 0).select("source_id", F.col("cells").alias("header")), "headers")
    rows = cells.where(F.col("row_id") > 0).join(header, "source_id")
    zipped = F.transform("header", lambda name, i: F.struct(F.trim(name).alias("name"), F.get("cells", i).alias("cell"), i.alias("at")))
    names = F.transform("header", lambda name: F.trim(name))
    known = F.filter(zipped, lambda z: z["name"].isNotNull() & (F.array_position(names, z["name"]) == z["at"] + 1))
    record = F.map_from_entries(F.transform(known, lambda z: F.struct(z["name"], z["cell"])))
    file = F.regexp_replace(F.element_at(F.split("source_id", "/"), -1), r"\.[^.]*$", "")
    return rows.select(F.url_decode(file).alias("sheet"), F.col("row_id").alias("row_no"), record.alias("record"))
