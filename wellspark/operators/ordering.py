"""Row-order operators that never put a whole well into one task.

A window partitioned by well alone would send the busiest well to one task.
Here each series is cut into chunks first: the window runs per (key, chunk), and
what has to cross a chunk border travels either as copied border rows
(:func:`with_halo`, for frames of bounded length) or as one summary row per chunk
(:func:`number_rows`, :func:`neighbours`, for running counts and nearest valid values).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from wellspark.functions.scalar import floor_div, micros

BLOCK_ROWS = 8192


def time_slice(ts, width_us: int) -> Column:
    return floor_div(micros(ts), width_us)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, out: str = "pos"
) -> DataFrame:
    """Adds the 1-based position of each row in its key's ``order``; ``chunk`` must grow with that order."""
    chunked = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    )
    return (
        chunked.withColumn("_inside", F.row_number().over(inside))
        .join(before, [*keys, "_chunk"])
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_chunk", "_inside", "_before")
    )


def positions(
    df: DataFrame, keys: Sequence[str], ts: str, width_us: int, out: str = "pos"
) -> DataFrame:
    """Adds the 1-based position of each row in its key's time order."""
    return number_rows(df, keys, [ts], time_slice(ts, width_us), out)


def block_of(pos, rows: int = BLOCK_ROWS) -> Column:
    return floor_div(F.col(pos) - 1, rows)


def with_halo(
    df: DataFrame, back: int | Column, ahead: int | Column = 0, pos: str = "pos", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``_block`` and copies the ``back``/``ahead`` rows around each block into it; they may be columns.

    Frames of at most ``back`` preceding and ``ahead`` following rows, partitioned by
    (key, ``_block``) and ordered by ``pos``, are then exact on the block's own rows;
    :func:`own_rows` removes the copies afterwards.
    """
    p = F.col(pos) - 1
    back, ahead = (c if isinstance(c, Column) else F.lit(c) for c in (back, ahead))
    first = F.greatest(floor_div(p - ahead, rows), F.lit(0).cast("bigint"))
    last = floor_div(p + back, rows)
    return df.withColumn("_block", F.explode(F.sequence(first, last)))


def own_rows(df: DataFrame, pos: str = "pos", rows: int = BLOCK_ROWS) -> DataFrame:
    return df.where(F.col("_block") == block_of(pos, rows))


def on_blocks(df: DataFrame, fun: Callable[[pd.DataFrame], None], added: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs ``fun`` on each block of :func:`with_halo`, in row order; it adds the columns of ``added`` (DDL) in place.

    A block is ``rows`` rows and its halo, so each call's memory is bounded however long a series is.
    """
    new = StructType.fromDDL(added)

    def block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", ignore_index=True)
        fun(part)
        return part[(part["pos"] - 1) // rows == part["_block"]]

    return df.groupBy("well", "_block").applyInPandas(block, StructType([*df.schema.fields, *new.fields]))


def neighbours(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], payloads: Sequence[str]
) -> DataFrame:
    """For each payload adds ``<p>_prev`` and ``<p>_next``: its nearest non-null value at or before / after the row.

    ``chunk`` must grow with ``order`` inside a key.
    """
    up = Window.partitionBy(*keys, chunk).orderBy(*order)
    down = Window.partitionBy(*keys, chunk).orderBy(*[F.col(c).desc() for c in order])
    ordinal = F.struct(*order) if len(order) > 1 else F.col(order[0])
    inner = df.select(
        "*",
        *[F.last(p, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{p}_prev") for p in payloads],
        *[F.last(p, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{p}_next") for p in payloads],
    )
    edges = df.groupBy(*keys, chunk).agg(
        *[F.max_by(p, F.when(F.col(p).isNotNull(), ordinal)).alias(f"{p}_last") for p in payloads],
        *[F.min_by(p, F.when(F.col(p).isNotNull(), ordinal)).alias(f"{p}_first") for p in payloads],
    )
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col(chunk).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *keys,
        chunk,
        *[F.last(f"{p}_last", ignorenulls=True).over(earlier).alias(f"{p}_from_earlier") for p in payloads],
        *[F.last(f"{p}_first", ignorenulls=True).over(later).alias(f"{p}_from_later") for p in payloads],
    )
    joined = inner.join(carried, [*keys, chunk], "left")
    for p in payloads:
        joined = joined.withColumn(f"{p}_prev", F.coalesce(f"{p}_prev", f"{p}_from_earlier")).withColumn(
            f"{p}_next", F.coalesce(f"{p}_next", f"{p}_from_later")
        )
    return joined.drop(*[f"{p}_{side}" for p in payloads for side in ("from_earlier", "from_later")])


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], chunk_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Unbounded forward fill of ``columns`` in ``order`` (a row number) per key."""
    names = df.columns
    chunked = df.withColumn("_chunk", floor_div(F.col(order).cast("bigint"), chunk_rows))
    filled = neighbours(chunked, keys, "_chunk", [order], columns)
    return filled.select(*[F.col(f"{c}_prev").alias(c) if c in columns else F.col(c) for c in names])


def sampling_gaps(df: DataFrame, keys: Sequence[str], ts: str, width_us: int) -> DataFrame:
    """One row per gap between consecutive samples of a key: ``(keys, gap)`` in seconds."""
    gap = ((micros("_ts") - micros("_before")) / F.lit(1e6)).alias("gap")
    sliced = df.select(*keys, F.col(ts).alias("_ts"), time_slice(ts, width_us).alias("_slice"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_ts")
    within = sliced.select(*keys, "_ts", F.lag("_ts").over(inside).alias("_before"))
    ends = sliced.groupBy(*keys, "_slice").agg(F.min("_ts").alias("_ts"), F.max("_ts").alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    between = ends.select(*keys, "_ts", F.lag("_end").over(across).alias("_before"))
    both = within.unionByName(between).where(F.col("_before").isNotNull())
    return both.select(*keys, gap)
