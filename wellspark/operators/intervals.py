"""Labelled intervals: building them and joining points to them.

Range joins get an equality key first: intervals are cut along fixed-width time
buckets, so a busy well spreads over its buckets. Pooling joins use
:func:`coverage` and :func:`first_open`, whose segments never overlap, so a point meets
at most one row however many intervals cover it. Lookups at the ends of intervals
(:func:`uncovered`, :func:`asof_nearest`) are sweeps over points and ends together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wellspark.functions.scalar import canon_well, classify_label, floor_div, label_set, micros
from wellspark.operators.ordering import BLOCK_ROWS, forward_fill, neighbours, number_rows, time_slice
from wellspark.schema import DAY, CauseRules
from wellspark.staging import stage

BUCKET_US = DAY
_SWEEP_US = 64 * DAY  # slice width when interval endpoints are swept
_LISTED = 128  # points, or intervals, of one bucket that come in one list
_PAIRS = 1 << 24  # pairs of point and interval that one task gives out, about
_NODES = 40  # levels of the tree over slices: more than any time span needs


def ffill_annotations(rows: DataFrame, source: str = "source_id") -> DataFrame:
    """Well and cause cells left empty repeat the value above, in sheet order."""
    return forward_fill(rows, [source], "row_id", ["well", "cause"])


def well_bounds(base: DataFrame) -> DataFrame:
    return base.groupBy("well").agg(F.min("ts").alias("data_start"), F.max("ts").alias("data_end"))


def clip_intervals(ann: DataFrame, bounds: DataFrame) -> DataFrame:
    """Annotations of known wells with ``start_ts``/``end_ts`` clipped to the data; empty ones are dropped."""
    start = F.greatest(F.coalesce("start_ts", "data_start"), F.col("data_start"))
    end = F.least(F.coalesce("end_ts", "data_end"), F.col("data_end"))
    return (
        ann.join(bounds, "well")
        .withColumns({"start_ts": start, "end_ts": end})
        .where(F.col("start_ts") < F.col("end_ts"))
        .drop("data_start", "data_end")
    )


def reference_intervals(ann: DataFrame, base: DataFrame, rules: CauseRules) -> DataFrame:
    """Annotations with a known label as intervals (layout ``INTERVALS``)."""
    known = (
        ann.withColumn("well", canon_well("well"))
        .withColumn("cause", F.trim("cause"))
        .withColumn("label", classify_label("cause", label_set(rules.anomaly), label_set(rules.normal)))
        .where(F.col("label").isNotNull() & F.col("well").isNotNull())
    )
    return clip_intervals(known, well_bounds(base)).select(
        F.col("row_id").cast("bigint").alias("interval_id"),
        F.col("row_id").cast("bigint").alias("row_id"),
        "well",
        "start_ts",
        "end_ts",
        "label",
        "cause",
        "notes",
    )


def split_holdout(intervals: DataFrame, holdout: Sequence[str]) -> DataFrame:
    """Intervals of wells outside the holdout list."""
    return intervals.where(~F.col("well").isin(list(holdout))) if holdout else intervals


def train_or_all(intervals: DataFrame, holdout: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Training intervals; a group (or the whole table) made of holdout wells only is kept entirely."""
    train = split_holdout(intervals, holdout)
    if not by:
        return intervals if train.isEmpty() else train
    is_train = ~F.col("well").isin(list(holdout)) if holdout else F.lit(True)
    marked = intervals.withColumn("_train", is_train)
    some = marked.groupBy(*by).agg(F.bool_or("_train").alias("_some"))
    return marked.join(some, list(by)).where(F.col("_train") | ~F.col("_some")).drop("_train", "_some")


def coverage(intervals: DataFrame) -> DataFrame:
    """Disjoint segments with the number of intervals over each: ``(well, seg_start, seg_end, weight)`` in microseconds."""
    starts = intervals.select("well", micros("start_ts").alias("us"), F.lit(1).alias("d"))
    ends = intervals.select("well", (micros("end_ts") + 1).alias("us"), F.lit(-1).alias("d"))
    marks = starts.unionByName(ends).groupBy("well", "us").agg(F.sum("d").alias("d"))
    marks = marks.withColumn("_slice", floor_div("us", _SWEEP_US))
    inside = Window.partitionBy("well", "_slice").orderBy("us")
    across = Window.partitionBy("well").orderBy("_slice")
    carried = (
        marks.groupBy("well", "_slice")
        .agg(F.sum("d").alias("_total"), F.min("us").alias("_first"))
        .select(
            "well",
            "_slice",
            F.coalesce(F.sum("_total").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.lead("_first").over(across).alias("_after"),
        )
    )
    swept = marks.select(
        "well",
        "_slice",
        "us",
        F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"),
        F.lead("us").over(inside).alias("_next"),
    )
    return (
        swept.join(carried, ["well", "_slice"])
        .select(
            "well",
            F.col("us").alias("seg_start"),
            (F.coalesce("_next", "_after") - 1).alias("seg_end"),
            (F.col("_run") + F.col("_before")).alias("weight"),
        )
        .where(F.col("weight") > 0)
    )


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(floor_div(start, width), floor_div(end, width)))


def bucketed_coverage(intervals: DataFrame, width: int = BUCKET_US) -> DataFrame:
    """Coverage cut along time buckets, the right side of :func:`weigh_points`.

    Staged, so that its written size decides whether it is broadcast. Given a result of its own it returns that, so
    whatever pools points over intervals takes either.
    """
    if {"seg_start", "_bucket"} <= set(intervals.columns):
        return intervals
    segments = coverage(intervals)
    cut = segments.select("*", _buckets(F.col("seg_start"), F.col("seg_end"), width).alias("_bucket"))
    return stage(cut, "segments")


def weigh_points(points: DataFrame, segments: DataFrame, how: str = "inner", width: int = BUCKET_US) -> DataFrame:
    """Points with ``weight``, the number of intervals over them (``segments`` from :func:`bucketed_coverage`)."""
    us = micros("ts")
    at = floor_div(us, width)
    left = points.withColumns({"_bucket": at, "_us": us})
    right = segments.withColumnRenamed("well", "_well").withColumnRenamed("_bucket", "_seg_bucket")
    match = (
        (F.col("well") == F.col("_well"))
        & (F.col("_bucket") == F.col("_seg_bucket"))
        & F.col("_us").between(F.col("seg_start"), F.col("seg_end"))
    )
    joined = left.join(right, match, how)
    return joined.drop("_bucket", "_us", "_well", "_seg_bucket", "seg_start", "seg_end")


def mark_normal(points: DataFrame, normal: DataFrame, out: str = "in_normal") -> DataFrame:
    """Adds whether a point lies in any of the intervals of its well."""
    marked = weigh_points(points, bucketed_coverage(normal), "left")
    return marked.withColumn(out, F.col("weight").isNotNull()).drop("weight")


def _in_lists(rows: DataFrame, order: Sequence[Column], *ends: Column) -> DataFrame:
    """Rows of each ``(well, _bucket)`` as lists of at most ``_LISTED`` neighbours in ``order``; ``ends`` sum a list up."""
    place = F.row_number().over(Window.partitionBy("well", "_bucket").orderBy(*order))
    held = F.struct(*[c for c in rows.columns if c not in ("well", "_bucket")])
    listed = rows.withColumns({"_list": floor_div(place - 1, _LISTED), "_row": held}).groupBy("well", "_bucket", "_list")
    return listed.agg(F.collect_list("_row").alias("_rows"), *ends)


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    start: Column | None = None,
    width: int = BUCKET_US,
) -> DataFrame:
    """One row per point and interval that holds it (both ends closed); ``start`` may widen the interval.

    Pairs are made last: points and intervals of a bucket come as lists of at most ``_LISTED`` neighbours in time, and
    the join makes a row per list of points and list of intervals that can meet. A row is opened and tested in the
    pipeline that follows, point by point over the same intervals. So most pairs come in runs that columnar files
    write in a few bits a pair, and a task has few intervals: tasks give out about ``_PAIRS``, and the lists of points of
    a busier bucket are dealt to several. All lists are staged, so that their written size decides the join.
    """
    begin = F.coalesce(start, F.col("start_ts")) if start is not None else F.col("start_ts")
    cut = intervals.select("*", micros(begin).alias("_from"), micros("end_ts").alias("_to"))
    cut = cut.select("*", _buckets(F.col("_from"), F.col("_to"), width).alias("_bucket"))
    low = F.col("_bucket") * width
    inside = [F.greatest("_from", low), F.least("_to", low + width)]
    ends = [F.min("_from").alias("_first_from"), F.max("_to").alias("_last_to")]
    spans = stage(_in_lists(cut, inside, *ends).withColumnRenamed("_rows", "_spans"), "interval-lists")
    met = points.where("well is not null and ts is not null").withColumn("_us", micros("ts"))
    met = met.withColumn("_bucket", floor_div("_us", width))
    lists = stage(_in_lists(met, [F.col("_us")], F.min("_us").alias("_first"), F.max("_us").alias("_last")), "point-lists")

    keys = ["well", "_bucket"]
    held = spans.groupBy(*keys).agg(F.sum(F.size("_spans")).alias("_held"))
    pairs = lists.groupBy(*keys).agg(F.sum(F.size("_rows")).alias("_met")).join(held, keys)
    pairs = stage(pairs.select(*keys, (F.col("_met") * F.col("_held")).alias("_pairs")), "bucket-pairs")
    parts = F.ceil(F.col("_pairs") / _PAIRS)
    dealt = lists.join(pairs, keys).withColumn("_part", F.pmod("_list", parts)).drop("_list", "_pairs")
    copied = spans.join(pairs, keys).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_list", "_pairs")
    tasks = (pairs.agg(F.sum("_pairs")).first()[0] or 0) // _PAIRS
    if tasks:  # a broadcast would leave the pairs to the tasks that read the other side
        tasks = max(tasks, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt, copied = (x.repartition(tasks, *keys, "_part") for x in (dealt.hint("merge"), copied))
    can_meet = (F.col("_first") <= F.col("_last_to")) & (F.col("_last") >= F.col("_first_from"))
    met = dealt.join(copied, [*keys, "_part"]).where(can_meet)
    opened = met.select("well", "_spans", F.inline("_rows")).select(*points.columns, "_us", F.inline("_spans"))
    return opened.where(F.col("_us").between(F.col("_from"), F.col("_to"))).drop("_us", "_from", "_to")


def point_spans(intervals: DataFrame, points: DataFrame, width: int = BUCKET_US) -> DataFrame:
    """``intervals`` with ``span``: those of one span hold the same points.

    A span is the well, the buckets of both ends, and how many of these buckets' points are before the start and up to
    the end.
    """
    us = micros("ts")
    times = points.select("well", floor_div(us, width).alias("_bucket"), us.alias("_us"))
    times = stage(times.groupBy("well", "_bucket").agg(F.collect_set("_us").alias("_times")), "point-times")
    rows = intervals.withColumns({"_from": floor_div(micros("start_ts"), width), "_to": floor_div(micros("end_ts"), width)})
    for end in ("_from", "_to"):
        rows = rows.join(times.select("well", F.col("_bucket").alias(end), F.col("_times").alias(f"{end}_times")), ["well", end], "left")
    before = F.size(F.filter(F.coalesce("_from_times", F.array().cast("array<bigint>")), lambda at: at < micros("start_ts")))
    until = F.size(F.filter(F.coalesce("_to_times", F.array().cast("array<bigint>")), lambda at: at <= micros("end_ts")))
    span = F.concat_ws("/", *[x.cast("string") for x in (F.col("_from"), before, F.col("_to"), until)], "well")
    return rows.select(*intervals.columns, span.alias("span"))


_OPEN = "well string, seg_start bigint, seg_end bigint, row_id bigint, interval_id bigint"


def _sweep_open(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces ``(well, slice, seg_start, seg_end, row_id, interval_id)`` sorted by slice and start to segments with the
    smallest open row. Open pieces wait in a heap; one that has ended leaves it when it gets to the top."""
    names = [c.split(" ")[0] for c in _OPEN.split(", ")]
    group, waiting, at = None, [], 0
    out: list[tuple] = []

    def advance(until: int | None) -> None:
        """Segments from ``at`` to just before ``until``."""
        nonlocal at
        while waiting and (until is None or at < until):
            row, end, interval = waiting[0]
            if end < at:
                heapq.heappop(waiting)
                continue
            stop = end if until is None else min(end, until - 1)
            if out and out[-1][0] == group[0] and out[-1][3] == row and out[-1][2] == at - 1:
                out[-1] = (*out[-1][:2], stop, row, interval)
            else:
                out.append((group[0], at, stop, row, interval))
            at = stop + 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for well, number, start, end, row, interval in zip(*[batch.column(i).to_pylist() for i in range(6)]):
            if (well, number) != group:
                if group is not None:
                    advance(None)
                group, at = (well, number), start
                waiting.clear()
            advance(start)
            at = max(at, start)
            heapq.heappush(waiting, (row, end, interval))
        if len(out) > 1:
            yield batch_of(out[:-1])
            del out[:-1]
    if group is not None:
        advance(None)
    if out:
        yield batch_of(out)


def first_open(intervals: DataFrame, width: int = _SWEEP_US) -> DataFrame:
    """Disjoint segments with the smallest ``row_id`` of the intervals over each: ``(well, seg_start, seg_end, row_id,
    interval_id)`` in microseconds.

    Time is cut into slices, each swept on its own. An interval takes part in the two slices that hold its ends. The
    slices in between are covered whole: they get the smallest such row by way of a binary tree over slices, to which
    an interval gives a few nodes and from which a slice asks its ancestors, so a long interval costs no row per slice.
    """
    spans = intervals.select("well", "row_id", "interval_id", micros("start_ts").alias("a"), micros("end_ts").alias("b"))
    spans = spans.withColumns({"_from": floor_div("a", width), "_to": floor_div("b", width)})
    ends = spans.withColumn("_slice", F.explode(F.array_distinct(F.array("_from", "_to"))))
    first, last = F.col("_slice") * width, (F.col("_slice") + 1) * width - 1
    piece = [F.greatest("a", first).alias("seg_start"), F.least("b", last).alias("seg_end")]
    pieces = ends.select("well", "_slice", *piece, "row_id", "interval_id")
    whole = spans.where(F.col("_to") - F.col("_from") > 1)
    whole = stage(whole.select("well", "row_id", "interval_id", (F.col("_from") + 1).alias("lo"), F.col("_to").alias("hi")), "whole-slices")
    if not whole.isEmpty():
        pieces = pieces.unionByName(_whole_slices(whole, spans, width))
    swept = pieces.repartition("well", "_slice").sortWithinPartitions("well", "_slice", "seg_start")
    return swept.select("well", "_slice", "seg_start", "seg_end", "row_id", "interval_id").mapInArrow(_sweep_open, _OPEN)


def _whole_slices(whole: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Slices ``lo <= s < hi`` of the intervals in ``whole`` with the smallest row over each."""
    # Nodes of the tree that make up [lo, hi): at level k those that start where lo or end where hi has to be rounded.
    level = lambda k: F.pow(F.lit(2.0), k)
    levels = F.sequence(F.lit(0), F.lit(_NODES))
    up = F.transform(levels, lambda k: F.struct(k.alias("k"), F.ceil(F.col("lo") / level(k)).alias("l"), F.floor(F.col("hi") / level(k)).alias("h")))
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    left = F.transform(F.filter(up, lambda n: (n["l"] < n["h"]) & odd(n["l"])), lambda n: F.struct(n["k"].alias("k"), n["l"].alias("node")))
    right = F.transform(F.filter(up, lambda n: (n["l"] < n["h"]) & odd(n["h"])), lambda n: F.struct(n["k"].alias("k"), (n["h"] - 1).alias("node")))
    least = F.min(F.struct("row_id", "interval_id")).alias("least")
    nodes = whole.select("well", "row_id", "interval_id", F.inline(F.concat(left, right))).groupBy("well", "k", "node").agg(least)
    reach = whole.groupBy("well").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    slices = reach.select("well", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("_slice"))
    above = F.transform(levels, lambda k: F.struct(k.alias("k"), F.floor(F.col("_slice") / level(k)).alias("node")))
    asked = slices.select("well", "_slice", F.inline(above)).join(nodes, ["well", "k", "node"])
    found = asked.groupBy("well", "_slice").agg(F.min("least").alias("least"))
    return found.select(
        "well", "_slice", (F.col("_slice") * width).alias("seg_start"), ((F.col("_slice") + 1) * width - 1).alias("seg_end"), "least.row_id", "least.interval_id"
    )


def containing(
    points: DataFrame, refs: DataFrame, id_columns: Sequence[str] = ("well", "ts"), width: int = BUCKET_US
) -> DataFrame:
    """Per point the first reference (annotation order) that contains it: ``(ids, interval_id)``."""
    segments = first_open(refs)
    cut = segments.select("*", _buckets(F.col("seg_start"), F.col("seg_end"), width).alias("_bucket"))
    found = weigh_points(points.select(*id_columns), stage(cut, "open-segments"), width=width)
    return found.select(*id_columns, "interval_id")


def uncovered(refs: DataFrame, points: DataFrame) -> DataFrame:
    """References that contain none of the points: the first point from their start on is after their end."""
    seekers = refs.select("well", F.col("start_ts").alias("ts"), F.lit(0).alias("_kind"), "interval_id", F.col("end_ts"))
    seen = points.select("well", "ts", F.lit(1).alias("_kind"), F.col("ts").alias("_at"))
    both = seekers.unionByName(seen, allowMissingColumns=True).withColumn("_slice", time_slice("ts", _SWEEP_US))
    around = neighbours(both, ["well"], "_slice", ["ts", "_kind"], ["_at"]).where("_kind = 0")
    hit = around.where(F.col("_at_next") <= F.col("end_ts"))
    return refs.join(hit.select("interval_id"), "interval_id", "left_anti")


def asof_nearest(
    left: DataFrame, right: DataFrame, left_id: str, width: int = _SWEEP_US
) -> DataFrame:
    """For each left row ``(well, <left_id>, ts)`` the nearest right time of its well, later on ties: adds ``near_ts``."""
    seekers = left.select("well", "ts", F.lit(1).alias("_seeks"), F.col(left_id).alias("_id"))
    found = right.select("well", "ts", F.lit(0).alias("_seeks"), F.col("ts").alias("_at"))
    both = seekers.unionByName(found, allowMissingColumns=True).withColumn("_slice", time_slice("ts", width))
    around = neighbours(both, ["well"], "_slice", ["ts", "_seeks"], ["_at"])
    back = micros("ts") - micros("_at_prev")
    ahead = micros("_at_next") - micros("ts")
    near = F.when(F.col("_at_prev").isNull() | (ahead <= back), F.col("_at_next")).otherwise(F.col("_at_prev"))
    return around.where(F.col("_seeks") == 1).select(
        "well", F.col("_id").alias(left_id), "ts", F.coalesce(near, F.col("_at_prev")).alias("near_ts")
    )


def well_causes(intervals: DataFrame) -> DataFrame:
    """First anomaly cause of each well in annotation order: ``(well, cause)``."""
    anomalies = intervals.where((F.col("label") == "anomaly") & (F.col("cause") != ""))
    return anomalies.groupBy("well").agg(F.min_by("cause", "row_id").alias("cause"))


def map_groups(df: DataFrame, rules: CauseRules, cause: str = "cause", out: str = "cause_group") -> DataFrame:
    """Adds the cause's group; a cause without a profile is its own group."""
    mapped = F.col(cause)
    for name, group in rules.groups().items():
        mapped = F.when(F.col(cause) == name, F.lit(group)).otherwise(mapped)
    return df.withColumn(out, mapped)


def cause_references(intervals: DataFrame, causes: DataFrame) -> DataFrame:
    """Anomaly intervals whose cause is their well's cause."""
    return intervals.where(F.col("label") == "anomaly").join(causes, ["well", "cause"], "left_semi")


def windows_by_well(intervals: DataFrame) -> DataFrame:
    """Interval windows of each well and label, numbered in annotation order."""
    chunk = floor_div("row_id", BLOCK_ROWS)
    numbered = number_rows(intervals, ["well", "label"], ["row_id"], chunk, "nth")
    return numbered.select("well", "label", "nth", "start_ts", "end_ts")
