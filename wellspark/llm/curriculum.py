"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight that changes linearly over training time t in [0, 1]. Integrated, the
schedule says how many words of the source are due by time t; the source's target is that demand
at t = 1. Documents of a source stand one after another in a fixed pseudo-random order, a second
pass following the first, and a document's place in that row of words is turned into a training
position by inverting the demand. The mix is the documents sorted by position.

Targets: the sources share ``share`` times all words by weight; no source gives more than
``limit`` times its own words, and what it cannot give is shared by the others, again by weight.
Sorted by ``limit * words / weight`` the full sources come first, so one pass with running sums
finds the level at which the rest stops: the highest one that the next source does not exceed.

Running sums over a source are taken in two steps - per bucket of the pseudo-random order, then
inside a bucket - so a source with a third of all rows is never one task's work. Only per-source
totals go through an unpartitioned window.

Null texts have no words; the null source is a source of its own and ranks last; empty documents
are kept with nothing taken; repeated rows stand one after another; rows without an id share one
bucket per source; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wellspark.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
_BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``(source, source_size, rank, weight, target)`` from rows ``(source, size)``; ranks from 1, by name."""
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.encode("source", "UTF-8").asc_nulls_last())
    picks = F.array(*[F.lit(float(w)) for w in weights])
    totals = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.get(picks, (F.col("rank") - 1) % len(weights)))
        .withColumn("_cap", F.col("source_size") * F.lit(float(limit)))
        .withColumn("_due", F.sum("source_size").over(whole) * F.lit(float(share)))
    )
    # Ratios as decimals would round; comparing doubles is enough, ties fill at the same level.
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), F.encode("source", "UTF-8").asc_nulls_last())
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    levels = totals.withColumn(
        "_level",
        (F.col("_due") - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))) / F.sum("weight").over(rest),
    ).withColumn("_stop", F.max(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))).over(whole))
    return levels.select(
        "source",
        "source_size",
        "rank",
        "weight",
        F.least("_cap", F.coalesce(F.col("_stop") * F.col("weight"), F.col("_cap"))).alias("target"),
    )


def due(t: Column, start: Column, end: Column) -> Column:
    """Share of the target due by time t, where the weight goes linearly from ``start`` to ``end``."""
    return (start * t + (end - start) * t * t / 2) / ((start + end) / 2)


def position(share: Column, start: Column, end: Column) -> Column:
    """Time at which ``share`` of the target is due: the inverse of :func:`due`."""
    slope = (end - start) / 2
    goal = share * (start + end) / 2
    # The root written so that it also holds for a constant weight.
    return F.least(F.lit(1.0), 2 * goal / (start + F.sqrt(F.greatest(F.lit(0.0), start * start + 4 * slope * goal))))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    limit: float = 2.0,
    drift: Sequence[float] = (1.5, 0.5),
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``(row_id, source, size, source_size, target, place, taken, copies, row)``.

    ``place`` is the number of words before the document in its source's fixed order.
    ``copies`` lists what the mix takes: pass number, words (the first ones of the document where a
    target ends inside it) and training position. ``row`` is a struct of the ``carry`` columns.
    The weights of even-ranked sources (by name, from 1, null last) go from ``drift[0]`` to ``drift[1]`` of their mean over
    training, those of odd-ranked ones the other way.
    """
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    bucket = F.substring(key, 1, _BUCKET_DIGITS)
    source = F.col(source_col).cast("string")
    # One key for the window and the join, so the rows are exchanged once.
    slot = F.concat(bucket, F.coalesce(F.concat(F.lit("/"), source), F.lit("")))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("row_id"),
        source.alias("source"),
        word_count(F.col(text_col)).alias("size"),
        key.alias("_key"),
        slot.alias("_slot"),
        row.alias("row"),
    )
    sized = docs.select(source.alias("source"), bucket.alias("_bucket"), slot.alias("_slot"), word_count(F.col(text_col)).alias("size"))
    buckets = stage(sized.groupBy("source", "_bucket", "_slot").agg(F.sum("size").alias("size")), "buckets")
    targets = source_targets(buckets, weights, share, limit).withColumnRenamed("source", "_source")
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        buckets.withColumn("_base", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .select("_slot", "_base", "source_size", "target", "rank")
    )
    inside = Window.partitionBy("_slot").orderBy("_key", "row_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, "_slot")
    passes = range(int(-(-limit // 1)))
    goal = F.round("target").cast("bigint")
    even = F.col("rank") % 2 == 0
    start = F.when(even, float(drift[0])).otherwise(float(drift[1]))
    end = F.when(even, float(drift[1])).otherwise(float(drift[0]))
    copies = []
    for p in passes:
        at = F.col("_base") + F.col("_in") + F.lit(p) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal - at))
        where = position(at / F.greatest(goal, F.lit(1)), start, end)
        copies.append(F.struct(F.lit(p).alias("pass"), words.alias("words"), where.alias("position")))
    return placed.withColumn("_all", F.array(*copies)).select(
        "row_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("_base") + F.col("_in")).alias("place"),
        F.aggregate("_all", F.lit(0).cast("bigint"), lambda n, c: n + c["words"]).alias("taken"),
        F.filter("_all", lambda c: c["words"] > 0).alias("copies"),
        "row",
    )


def schedule(mixed: DataFrame) -> DataFrame:
    """The mix as a written table in training order: one row per copy, range-sorted by position, then one without a
    position for each document of which nothing is taken: ``(row_id, source, size, source_size, target, place, pass,
    words, position)``."""
    kept = mixed.select("row_id", "source", "size", "source_size", "target", "place", F.explode_outer("copies").alias("copy"))
    rows = stage(kept.select(*[c for c in kept.columns if c != "copy"], "copy.*"), "copies")
    order = [F.col("position").asc_nulls_last(), F.col("pass")]
    return stage(rows.repartitionByRange(*order).sortWithinPartitions(*order), "schedule")


def scheduled_documents(planned: DataFrame, passes: int = 2) -> DataFrame:
    """What a :func:`schedule` takes of each document: ``(row_id, size, source_size, target, taken, position_1, …)``."""
    keys = ["row_id", "source", "size", "source_size", "target", "place"]
    at = [F.max(F.when(F.col("pass") == p, F.col("position"))).alias(f"position_{p + 1}") for p in range(passes)]
    # Only empty documents share a place; each of them is a row of the result.
    rows = F.count_if(F.coalesce("pass", F.lit(0)) == 0).cast("int").alias("_rows")
    found = planned.groupBy(*keys).agg(F.coalesce(F.sum("words"), F.lit(0)).alias("taken"), *at, rows)
    again = F.explode(F.array_repeat(F.lit(0), F.col("_rows"))).alias("_row")
    return found.select("*", again).drop("_rows", "_row", "place", "source")


def training_order(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixed documents themselves, in the columns of ``docs``, range-sorted by training position.

    A document taken twice is there twice; where a target ends inside a document only its first
    words are there.
    """
    mixed = mix(docs, text_col=text_col, carry=docs.columns, **options)
    taken = mixed.select("row", "size", F.explode("copies").alias("copy"))
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, 1, F.col("copy.words").cast("int")), " ")
    whole = F.col("copy.words") >= F.col("size")
    text = F.when(whole, F.col("row")[text_col]).otherwise(cut)
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(text.alias(c))
        elif c == length_col:
            columns.append(F.when(whole, F.col("row")[c]).otherwise(F.length(cut)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    ordered = taken.select(F.col("copy.position").alias("_position"), F.col("copy.pass").alias("_pass"), F.struct(*columns).alias("row"))
    ordered = ordered.repartitionByRange("_position", "_pass").sortWithinPartitions("_position", "_pass")
    return ordered.select("row.*")
