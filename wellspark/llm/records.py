"""Token-id shards: length-delimited binary records with masked checksums and an offset index.

A shard is a 16-byte header and one record per document::

    header   magic "WSTOKEN1", bytes per id (u4), reserved (u4)
    record   length of data (u8), masked checksum of those 8 bytes (u4),
             data: the document's ids, little-endian, masked checksum of data (u4)

The checksum is CRC-32, rotated right by 15 bits and shifted by a constant, so that a stored
checksum inside checked data is harmless. The index has one row per document with the place
of its record, so readers can fetch records in any order; ``verify`` recomputes both checksums.

Documents are range-partitioned by id: one exchange of the texts, one file (or several of at
most ``max_bytes``) per partition. A retried task writes a new file name and only the index
rows of the attempt that counts are kept, so lost executors leave unreferenced files, not
wrong ones. Null texts have only the end id; rows without an id come first; rows with equal
ids are each written, in text order; an empty table gives no shard and an empty index.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wellspark.llm.arrow import batch_of, schema_of, slices
from wellspark.llm.files import open_input, open_output
from wellspark.llm.tokens import DEFAULT_VOCABULARY, ENCODE_ROWS, encoder
from wellspark.staging import new_path, stage

MAGIC = b"WSTOKEN1"
HEADER = struct.Struct("<8sII")
LENGTH = struct.Struct("<Q")
CHECK = struct.Struct("<I")
MASK_DELTA = 0xA282EAD8  # fixed value of the public record format this framing follows
INDEX = "shard string, row_id bigint, place bigint, n_bytes bigint, n_tokens bigint, before bigint, width int"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = LENGTH.pack(len(data))
    return b"".join((head, CHECK.pack(masked(head)), data, CHECK.pack(masked(data))))


def unframe(record: bytes, verify: bool = True) -> bytes:
    """The data of one record; a wrong length or checksum raises."""
    size = LENGTH.unpack_from(record)[0]
    data = record[12 : 12 + size]
    if len(record) != size + 16:
        raise ValueError(f"record of {len(record)} bytes holds a length of {size}")
    if verify and (
        CHECK.unpack_from(record, 8)[0] != masked(record[:8]) or CHECK.unpack_from(record, 12 + size)[0] != masked(data)
    ):
        raise ValueError("checksum mismatch")
    return data


def _write(batches: Iterable[pa.RecordBatch], folder: str, vocabulary: str, end_id: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    schema = schema_of(INDEX)
    enc = encoder(vocabulary)
    end = np.array([end_id], dtype=enc.dtype).tobytes()
    prefix = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
    out, name, place, before, number = None, "", 0, 0, 0
    for batch in slices(batches, ENCODE_ROWS):
        rows = []
        for key, encoded in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
            if out is None or place >= max_bytes:
                if out is not None:
                    out.close()
                name = f"{prefix}-{number:04d}.tok"
                out, place, before, number = open_output(name), HEADER.size, 0, number + 1
                out.write(HEADER.pack(MAGIC, enc.dtype.itemsize, 0))
            data = encoded.tobytes() + end
            record = frame(data)
            out.write(record)
            n = len(data) // enc.dtype.itemsize
            rows.append((name, key, place, len(record), n, before, enc.dtype.itemsize))
            place, before = place + len(record), before + n
        yield batch_of(list(zip(*rows)), schema.names, schema.types)
    if out is not None:
        out.close()


def write_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = DEFAULT_VOCABULARY,
    end_id: int = 1,
    folder: str | None = None,
    max_bytes: int = 256 << 20,
) -> DataFrame:
    """Writes the shards and returns the index ``(shard, row_id, place, n_bytes, n_tokens, before, width)``.

    ``before`` counts the ids of earlier documents in the same shard.
    """
    folder = folder or new_path(docs.sparkSession, "shards")
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("body"))
    ordered = rows.repartitionByRange("row_id").sortWithinPartitions("row_id", "body")
    return stage(ordered.mapInArrow(lambda b: _write(b, folder, vocabulary, end_id, max_bytes), INDEX), "shard-index")


def shard_starts(index: DataFrame) -> DataFrame:
    """``(shard, base)``: ids in all shards before; one row per file goes through the window."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.min("row_id").alias("first_id"))
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))


READ = "shard string, row_id bigint, n_tokens bigint, before bigint, ids binary"


def _read(batches: Iterable[pa.RecordBatch], verify: bool) -> Iterator[pa.RecordBatch]:
    schema = schema_of(READ)
    name, source = None, None
    for batch in slices(batches):
        rows = []
        for row in batch.to_pylist():
            if row["shard"] != name:
                if source is not None:
                    source.close()
                name, source = row["shard"], open_input(row["shard"])
                if HEADER.unpack(source.read_at(HEADER.size, 0))[:2] != (MAGIC, row["width"]):
                    raise ValueError(f"not a token shard: {name}")
            data = unframe(source.read_at(row["n_bytes"], row["place"]), verify)
            ids = np.frombuffer(data, dtype=f"<u{row['width']}").astype("<u4")
            rows.append((name, row["row_id"], len(ids), row["before"], ids.tobytes()))
        yield batch_of(list(zip(*rows)), schema.names, schema.types)
    if source is not None:
        source.close()


def read_shards(index: DataFrame, verify: bool = True) -> DataFrame:
    """Records of the indexed documents: ``(shard, row_id, n_tokens, before, ids)``, ids as little-endian u4."""
    files = max(1, index.select("shard").distinct().count())
    by_file = index.repartition(files, "shard").sortWithinPartitions("shard", "place")
    return by_file.mapInArrow(lambda b: _read(b, verify), READ)
