"""Small helpers for Arrow-batched tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Rows and bytes handled at a time inside a task: bound the memory of one step whatever Spark's batch size is.
SLICE_ROWS = 256
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows, fewer where rows are large on average.

    After the last one a task's worker, which later stages use again, gives back the memory it no longer needs.
    """
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()


_TYPES = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
}


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string of plain types and arrays of them."""
    fields = []
    for column in ddl.split(", "):
        name, kind = column.split(" ")
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append((name, _TYPES[inner] if inner == kind else pa.list_(_TYPES[inner])))
    return pa.schema(fields)


def batch_of(columns: Sequence, names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=list(names))


def utf8(values: Iterable[str | None]) -> list[bytes]:
    """Texts as UTF-8; null is the empty text."""
    return [b"" if v is None else v.encode("utf-8") for v in values]
