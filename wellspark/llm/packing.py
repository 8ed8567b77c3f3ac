"""Best-two-fit packing of tokenised documents into sequences of at most ``capacity`` tokens.

Documents longer than a sequence are cut into full pieces and a rest. How pieces go together
depends on their lengths alone, so the plan is made from the histogram of lengths: at most
``capacity`` counts, whatever the corpus holds. A bin is filled greedily with the longest
pieces that still fit; then its smallest piece is exchanged for two unpacked pieces that fill
the gap more tightly. The same filling is repeated for as long as its lengths last, so the plan
is a short list of fillings with repeat counts. Pieces then take their places by their rank
among the pieces of their length.

Ranks are counted in two steps - pieces of a length per slice of the table, then the slices
before - so a length that a third of all rows share is never gathered. Null texts are empty
documents (the end id alone); repeated rows and rows without an id are each packed; an empty
table gives no piece.
"""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wellspark.llm.arrow import batch_of, schema_of, slices
from wellspark.llm.tokens import DEFAULT_VOCABULARY, ENCODE_ROWS, encoder
from wellspark.staging import stage

PIECES = (
    "row_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, slice string, nth bigint"
)


def _cut(batches: Iterable[pa.RecordBatch], vocabulary: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    schema = schema_of(PIECES)
    enc = encoder(vocabulary)
    end = np.array([end_id], dtype=enc.dtype).tobytes()
    width = enc.dtype.itemsize
    part, seen = uuid.uuid4().hex[:16], {}
    for batch in slices(batches, ENCODE_ROWS):
        rows = []
        for key, encoded in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
            data = encoded.tobytes() + end
            for piece, at in enumerate(range(0, len(data), capacity * width)):
                own = data[at : at + capacity * width]
                n = len(own) // width
                nth = seen[n] = seen.get(n, -1) + 1
                crc = zlib.crc32(np.frombuffer(own, dtype=enc.dtype).astype("<u4").tobytes())
                rows.append((key, piece, at // width, n, crc, own, part, nth))
        yield batch_of(list(zip(*rows)), schema.names, schema.types)


def cut_pieces(
    docs: DataFrame,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = DEFAULT_VOCABULARY,
    end_id: int = 0,
) -> DataFrame:
    """Tokenised pieces, written once: ids in the vocabulary's width, and the piece's number ``nth``
    among those of its length in its ``slice`` of the table."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("body"))
    return stage(rows.mapInArrow(lambda b: _cut(b, vocabulary, end_id, capacity), PIECES), "pieces", compression="zstd")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, for ``counts`` pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    plan: list[tuple[tuple[int, ...], int]] = []

    def largest(limit: int, used: dict[int, int]) -> int | None:
        """Longest unpacked length up to ``limit`` that the bin has not used up."""
        at = bisect.bisect_right(lengths, limit) - 1
        while at >= 0 and left[lengths[at]] <= used.get(lengths[at], 0):
            at -= 1
        return lengths[at] if at >= 0 else None

    def best_two(limit: int, used: dict[int, int]) -> tuple[int, int] | None:
        """Two unpacked lengths whose sum is the largest up to ``limit``."""
        free = [n for n in lengths[: bisect.bisect_right(lengths, limit)] if left[n] > used.get(n, 0)]
        low, high, best = 0, len(free) - 1, None
        while low <= high:
            total = free[low] + free[high]
            if total > limit:
                high -= 1
                continue
            if low < high or left[free[low]] - used.get(free[low], 0) >= 2:
                if best is None or total > sum(best):
                    best = (free[high], free[low])
                if total == limit:
                    break
            low += 1
        return best

    while lengths:
        used: dict[int, int] = {}
        gap = capacity
        while gap > 0 and (n := largest(gap, used)) is not None:
            used[n] = used.get(n, 0) + 1
            gap -= n
        if gap > 0:
            smallest = min(used)
            used[smallest] -= 1
            two = best_two(gap + smallest, used)
            if two is not None and sum(two) > smallest:
                for n in two:
                    used[n] = used.get(n, 0) + 1
            else:
                used[smallest] += 1
        used = {n: k for n, k in used.items() if k}
        times = min(left[n] // k for n, k in used.items())
        filling = tuple(n for n in sorted(used, reverse=True) for _ in range(used[n]))
        plan.append((filling, times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                del lengths[bisect.bisect_left(lengths, n)]
    return plan


def _places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """The plan by length: ranks ``[first, last)`` of a length go to bins from ``bin`` on, at ``offset``."""
    rows, taken, number = [], {}, 0
    for filling, times in plan:
        offset = 0
        for n in filling:
            first = taken.get(n, 0)
            rows.append((n, first, first + times, number, offset))
            taken[n] = first + times
            offset += n
        number += times
    return rows


def place_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` without ids, with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    per_slice = pieces.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices_ = stage(
        per_slice.select("length", "slice", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "slices"
    )
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in slices_.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = _places(plan_bins(counts, capacity))
    schema = "length bigint, first bigint, last bigint, bin bigint, offset bigint"
    places = stage(spark.createDataFrame(rows, schema), "places")
    ranked = (
        pieces.drop("ids")
        .join(slices_.select("length", "slice", "base"), ["length", "slice"])
        .withColumn("rank", F.col("base") + F.col("nth"))
    )
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    return (
        ranked.join(places.withColumnRenamed("length", "_length"), (F.col("length") == F.col("_length")) & inside)
        .withColumn("sequence_id", F.col("bin") + F.col("rank") - F.col("first"))
        .select("row_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "slice", "nth")
    )


SEQUENCES = "sequence_id bigint, n_tokens bigint, pieces int, doc_ids array<bigint>, offsets array<bigint>, ids binary"


def _sequence(rows: list[dict], width: int) -> tuple:
    ids = b"".join(r["ids"] for r in rows)
    return rows[0]["sequence_id"], len(ids) // width, len(rows), [r["row_id"] for r in rows], [r["offset"] for r in rows], ids


def _join(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sequence and offset to one row per sequence."""
    schema, rows = schema_of(SEQUENCES), []
    for batch in slices(batches):
        out = []
        for row in batch.to_pylist():
            if rows and row["sequence_id"] != rows[0]["sequence_id"]:
                out.append(_sequence(rows, width))
                rows = []
            rows.append(row)
        if out:
            yield batch_of(list(zip(*out)), schema.names, schema.types)
    if rows:
        yield batch_of(list(zip(_sequence(rows, width))), schema.names, schema.types)


def build_sequences(pieces: DataFrame, placed: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The packed sequences themselves, each with its documents and their offsets.

    ``ids`` are little-endian in the vocabulary's width.
    """
    keys = ["slice", "length", "nth"]
    rows = pieces.select(*keys, "row_id", "ids").join(placed.select(*keys, "sequence_id", "offset"), keys)
    ordered = rows.select("sequence_id", "offset", "row_id", "ids").repartition("sequence_id")
    width = encoder(vocabulary).dtype.itemsize
    return ordered.sortWithinPartitions("sequence_id", "offset").mapInArrow(lambda b: _join(b, width), SEQUENCES)
