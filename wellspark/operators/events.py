"""Event starts, their matching to labelled intervals, and detection records."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wellspark.functions.scalar import (
    base_signal,
    direction,
    floor_div,
    from_micros,
    micros,
    minutes_between,
    most_lead,
    notes_text,
    score,
)
from wellspark.operators.intervals import asof_nearest, cause_references, containing, mark_normal, uncovered
from wellspark.operators.ordering import neighbours, own_rows, with_halo
from wellspark.operators.residual import ResidualModel, ewma_flags, spike_flag, t2_score
from wellspark.schema import DAY, MINUTE, DetectSettings
from wellspark.staging import stage

SCORED = (
    "well", "ts", "pos", "pressure_delta", "pressure_slope", "current_delta", "temperature_delta",
    "t2_stat", "t2_flag", "ewma_flag", "spike_flag", "residual_flag", "base_flag", "signal",
)


def score_points(
    features: DataFrame,
    rules: DataFrame,
    model: ResidualModel | None,
    normals: DataFrame,
    cfg: DetectSettings,
) -> DataFrame:
    """Flags and the combined signal at every grid point of the wells in ``rules`` (columns ``SCORED``)."""
    rows = features.join(rules.select("well", "thr_delta", "thr_slope", "holdout"), "well")
    threshold = F.lit(model.threshold if model else None).cast("double")
    rows = rows.withColumns(
        {
            "t2_stat": t2_score(model),
            "spike_flag": spike_flag(model, cfg.residual.spike_limit),
            "base_flag": base_signal("pressure_delta", "pressure_slope", "thr_delta", "thr_slope"),
            "_steep": F.coalesce(F.abs("pressure_slope") >= F.col("thr_slope"), F.lit(False)),
        }
    ).withColumn("t2_flag", F.coalesce(F.col("t2_stat") > threshold, F.lit(False)))
    averaged = ewma_flags(features, model, cfg.residual)
    if averaged is None:
        rows = rows.withColumn("ewma_flag", F.lit(False))
    else:
        flagged = averaged.withColumn("_ewma", F.lit(True))
        rows = rows.join(flagged, ["well", "pos"], "left").withColumn("ewma_flag", F.coalesce("_ewma", F.lit(False)))
    rows = mark_normal(rows, normals)
    exempt = F.col("holdout") | ~F.col("in_normal")
    rows = rows.withColumn("residual_flag", F.col("t2_flag") & F.col("spike_flag") & F.col("_steep") & exempt)
    return rows.withColumn("signal", F.col("base_flag") | F.col("residual_flag")).select(*SCORED)


def rising_edges(signals: DataFrame) -> DataFrame:
    """The first row of each unbroken run of signal rows; input holds signal rows only."""
    order = Window.partitionBy("well", "_block").orderBy("pos")
    rows = with_halo(signals, back=1).withColumn("_before", F.lag("pos").over(order))
    return own_rows(rows).where(F.col("_before").isNull() | (F.col("_before") < F.col("pos") - 1)).drop("_block", "_before")


def suppress_gap(edges: DataFrame, gap_minutes: float) -> DataFrame:
    """Edges at least ``gap_minutes`` after the last kept one of their well: ``(well, ts)``.

    Every edge points to the one that would be kept next if it were kept itself: the first at least the gap later.
    An edge that far after the edge before it is kept in any case, so chains of pointers begin there and end before
    the next such edge. Kept edges are marked along the chains by pointer jumping: each round doubles what is marked.
    """
    gap = int(gap_minutes * MINUTE)
    width = max(gap, 8 * DAY)
    us = micros("ts")
    slices = F.explode(F.sequence(floor_div(us, width), floor_div(us + F.lit(max(gap - 1, 0)), width)))
    order = Window.partitionBy("well", "_slice").orderBy("_us")
    near = edges.select("well", us.alias("_us"), slices.alias("_slice")).withColumn("_before", F.lag("_us").over(order))
    own = near.where(F.col("_slice") == floor_div("_us", width))
    head = F.coalesce(F.col("_us") - F.col("_before") >= gap, F.lit(True))
    marked = own.select("well", "_us", head.alias("head"))
    found = marked.select("well", "_us", F.lit(1).alias("_kind"), F.struct("_us", "head").alias("_at"))
    seekers = marked.select("well", (F.col("_us") + gap).alias("_us"), F.lit(0).alias("_kind"), F.col("_us").alias("us"), F.col("head").alias("kept"))
    both = found.unionByName(seekers, allowMissingColumns=True).withColumn("_slice", floor_div("_us", width))
    ahead = neighbours(both, ["well"], "_slice", ["_us", "_kind"], ["_at"]).where("_kind = 0")
    chain = stage(ahead.select("well", "us", "kept", F.when(~F.col("_at_next.head"), F.col("_at_next._us")).alias("to")), "edges")
    while not (pointing := chain.where("kept AND to IS NOT NULL")).isEmpty():
        reached = pointing.select("well", F.col("to").alias("us"), F.lit(True).alias("again"))
        jumps = chain.where("to IS NOT NULL").select("well", F.col("us").alias("to"), F.col("to").alias("far"))
        met = chain.join(reached, ["well", "us"], "left").join(jumps, ["well", "to"], "left")
        chain = stage(met.select("well", "us", F.coalesce("again", "kept").alias("kept"), F.col("far").alias("to")), "edges")
    return chain.where("kept").select("well", from_micros("us").alias("ts"))


_NO_TIME = -(1 << 62)  # stands for the time of a supplement that is not there


def _last_of(pointers: list[int], at: int) -> int:
    """Where a chain of pointers ends; what it passed then points further ahead."""
    while pointers[at] != at:
        pointers[at] = pointers[pointers[at]]
        at = pointers[at]
    return at


class _Times:
    """Times in order, in blocks of bounded length, so that adding one moves few others."""

    BLOCK = 2048

    def __init__(self):
        self.blocks: list[list[int]] = [[]]
        self.firsts: list[int] = []

    def _block_of(self, us: int) -> int:
        return max(0, bisect_right(self.firsts, us) - 1)

    def add(self, us: int) -> None:
        i = self._block_of(us)
        block = self.blocks[i]
        insort(block, us)
        self.firsts[i : i + 1] = [block[0]]
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[i : i + 1] = [block[:half], block[half:]]
            self.firsts[i : i + 1] = [block[0], block[half]]

    def any_between(self, low: int, high: int) -> bool:
        i = self._block_of(low)
        at = bisect_left(self.blocks[i], low)
        if at < len(self.blocks[i]):
            return self.blocks[i][at] <= high
        return i + 1 < len(self.firsts) and self.firsts[i + 1] <= high


class _Matcher:
    """Assigns the events of one well to its references, in time order.

    References are sorted once. An assigned one points to its neighbours on both sides, so finding the nearest free
    one takes about as long with a million references as with ten.
    """

    def __init__(self, well: str):
        self.well = well
        self.refs: dict[int, object] = {}
        self.taken: set[tuple[int, int]] = set()
        self.times = _Times()
        self.found: list[tuple] = []
        self.order: list[tuple[int, int, int]] | None = None  # (start, annotation order, id), once all are there
        self.left = 0  # references not yet assigned

    def add_reference(self, row) -> None:
        self.refs[row.interval_id] = row
        self.left += 1

    def _sort(self) -> None:
        self.order = sorted((r.start_us, r.ord, i) for i, r in self.refs.items())
        self.spans: dict[tuple[int, int], list[int]] = {}
        for at, (start, _, i) in enumerate(self.order, 1):
            self.spans.setdefault((start, self.refs[i].end_us), []).append(at)
        # Places count from 1; the ends, 0 and one past the last, are no reference.
        self.ahead = list(range(len(self.order) + 2))
        self.back = list(range(len(self.order) + 2))

    def nearest(self, us: int) -> int | None:
        """Free reference whose start is closest, first in annotation order on ties."""
        at = bisect_left(self.order, (us,)) + 1
        after, before = _last_of(self.ahead, at), _last_of(self.back, at - 1)
        around = [self.order[after - 1]] if after <= len(self.order) else []
        if before > 0:
            same_start = bisect_left(self.order, (self.order[before - 1][0],)) + 1
            around.append(self.order[_last_of(self.ahead, same_start) - 1])
        return min(around, key=lambda f: (abs(us - f[0]), f[1]))[2] if around else None

    def offer(self, row, us: int, supplemental: bool) -> None:
        if self.order is None:
            self._sort()
        inside = row.contain_id
        chosen = inside if inside >= 0 else self.nearest(us)
        if chosen is None:
            return
        ref = self.refs[chosen]
        key = (ref.start_us, ref.end_us)
        if key in self.taken or ref.start_us - us > row.most_lead:
            return
        self.taken.add(key)
        for at in self.spans[key]:
            self.ahead[at], self.back[at] = at + 1, at - 1
        self.left -= len(self.spans[key])
        self.times.add(us)
        self.found.append((self.well, us, chosen, supplemental))

    def close(self) -> list[tuple]:
        """Offers references that no recorded event falls into, then returns the records."""
        for ref in sorted(self.refs.values(), key=lambda r: r.ord):
            if ref.near_us == _NO_TIME:
                continue
            if not self.times.any_between(ref.start_us, ref.end_us):
                self.offer(ref, int(ref.near_us), True)
        return self.found


def _match_wells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["well", "us", "interval_id", "supplemental"]
    matcher = None
    for batch in batches:
        done: list[tuple] = []
        for row in batch.itertuples(index=False):
            if matcher is None or matcher.well != row.well:
                done += matcher.close() if matcher else []
                matcher = _Matcher(row.well)
            if row.kind == 0:
                matcher.add_reference(row)
            elif matcher.left or row.contain_id >= 0:
                matcher.offer(row, row.ord, False)
        if done:
            yield pd.DataFrame(done, columns=columns)
    if matcher is not None:
        yield pd.DataFrame(matcher.close(), columns=columns)


def match_references(
    events: DataFrame, refs: DataFrame, scored: DataFrame, rules: DataFrame, cfg: DetectSettings
) -> DataFrame:
    """``(well, ts, interval_id, supplemental)``: each event's reference, at most one event per reference.

    ``events`` are grid times; ``refs`` the anomaly references of each well's cause. An
    event inside a reference takes it; any other takes the nearest free one if the early
    gate allows. Then each uncovered reference of a training well is offered the grid
    point nearest its start. Later events inside the same reference cannot change
    anything, so only the first is passed on.
    """
    values = ("pressure_delta", "pressure_slope", "any_flag")
    flagged = scored.withColumn("any_flag", F.col("residual_flag") | F.col("ewma_flag") | F.col("spike_flag"))
    points = flagged.select("well", "ts", *values)
    wanted = refs.join(rules.where(~F.col("holdout")).select("well"), "well", "left_semi")
    nearest = asof_nearest(
        wanted.select("well", "interval_id", F.col("start_ts").alias("ts")), scored.select("well", "ts"), "interval_id"
    )
    nearest = stage(nearest.select("well", "interval_id", F.col("near_ts").alias("ts")), "nearest")
    spots = events.select("well", "ts").unionByName(nearest.select("well", "ts")).distinct()
    spots = stage(points.join(spots, ["well", "ts"]), "spots")
    inside = containing(spots, refs).withColumnRenamed("interval_id", "contain_id")
    spots = spots.join(inside, ["well", "ts"], "left").withColumn("contain_id", F.coalesce("contain_id", F.lit(-1)))

    usable = F.col("pressure_delta").isNotNull() & F.col("pressure_slope").isNotNull()
    known = spots.join(events.select("well", "ts"), ["well", "ts"], "left_semi").where(usable)
    firsts = (
        known.where(F.col("contain_id") >= 0)
        .groupBy("well", "contain_id")
        .agg(F.min_by(F.struct("ts", *values), "ts").alias("_e"))
        .select("well", "contain_id", "_e.*")
    )
    offers = known.where(F.col("contain_id") < 0).unionByName(firsts)
    offers = offers.withColumns({"kind": F.lit(1), "ord": micros("ts")}).drop("ts")
    # A supplement without a delta or slope is none.
    supplements = nearest.join(spots.where(usable), ["well", "ts"]).withColumn("near_us", micros("ts")).drop("ts")
    starts = (
        refs.select(
            "well", "interval_id", F.col("row_id").alias("ord"), micros("start_ts").alias("start_us"), micros("end_ts").alias("end_us")
        )
        .join(supplements, ["well", "interval_id"], "left")
        .withColumns({"kind": F.lit(0), "contain_id": F.coalesce("contain_id", F.lit(-1))})
    )
    limits = rules.select("well", "inflow", "leak", "thr_delta", "thr_slope")
    rows = starts.unionByName(offers, allowMissingColumns=True).join(limits, "well")
    lead = most_lead(*values, "thr_delta", "thr_slope", "inflow", "leak", cfg.early_guard_hours)
    numbers = {"most_lead": lead, "near_us": F.coalesce("near_us", F.lit(_NO_TIME)), **{c: F.coalesce(c, F.lit(0)) for c in ("interval_id", "start_us", "end_us")}}
    rows = rows.withColumns(numbers).select("well", "kind", "ord", "contain_id", "interval_id", "start_us", "end_us", "near_us", "most_lead")
    ordered = rows.repartition("well").sortWithinPartitions("well", "kind", "ord")
    matched = ordered.mapInPandas(_match_wells, "well string, us bigint, interval_id bigint, supplemental boolean")
    return matched.select("well", from_micros("us").alias("ts"), "interval_id", "supplemental")


def detection_records(
    matches: DataFrame, scored: DataFrame, base: DataFrame, refs: DataFrame, rules: DataFrame, cfg: DetectSettings
) -> DataFrame:
    """The 36-column detection record of every match."""
    snapshot = [c for c in SCORED if c not in ("pos", "t2_flag", "base_flag", "signal")]
    extrema = [f"Intake_Pressure_{side}" for side in ("min", "max")]
    base = base.drop("pos").withColumns({x: F.lit(None).cast("double") for x in extrema if x not in base.columns})
    named = refs.select("interval_id", F.col("start_ts").alias("reference_start"), "notes")
    rows = (
        matches.join(scored.select(*snapshot), ["well", "ts"])
        .join(base, ["well", "ts"])
        .join(named, "interval_id")
        .join(rules, "well")
    )
    lead = minutes_between("ts", "reference_start")
    return rows.select(
        "well",
        "cause",
        F.col("ts").alias("start"),
        F.col("ts").alias("raw_start"),
        F.col("ts").alias("aligned_start"),
        F.col("ts").alias("end"),
        F.lit(0.0).alias("duration_minutes"),
        F.lit("anomaly").alias("segment_type"),
        F.col("pressure_delta").alias("pressure_delta_median"),
        F.col("pressure_slope").alias("pressure_slope_median"),
        F.col("current_delta").alias("current_delta_median"),
        F.col("temperature_delta").alias("temperature_delta_median"),
        *[direction(f"{n}_delta", cfg.directions).alias(f"{n}_direction") for n in ("pressure", "current", "temperature")],
        F.col("Intake_Pressure").alias("pressure_mean"),
        F.col("Intake_Pressure_min").alias("pressure_min_15m"),
        F.col("Intake_Pressure_max").alias("pressure_max_15m"),
        F.col("ewma_flag").alias("ewma_triggered"),
        F.col("spike_flag").alias("spike_triggered"),
        F.col("t2_stat").alias("t2_max"),
        F.col("residual_flag").alias("residual_triggered"),
        F.col("Current").alias("current_mean"),
        F.col("Motor_Temperature").alias("temperature_mean"),
        F.col("Frequency").alias("frequency_mean"),
        score("pressure_delta", "pressure_slope").alias("score"),
        F.lit("anomaly").alias("reference_match"),
        notes_text("notes").alias("reference_notes"),
        "reference_start",
        lead.alias("reference_delta_minutes"),
        lead.alias("reference_raw_delta_minutes"),
        lead.alias("reference_aligned_delta_minutes"),
        F.col("thr_delta").alias("threshold_pressure_delta"),
        F.col("thr_slope").alias("threshold_pressure_slope"),
        F.col("normal_delta").alias("threshold_normal_pressure_delta"),
        F.col("normal_slope").alias("threshold_normal_pressure_slope"),
    )


def event_snapshot(events: DataFrame, scored: DataFrame, base: DataFrame) -> DataFrame:
    """Features and grid values at each event; events without a delta or slope are dropped."""
    rows = events.select("well", "ts").join(scored, ["well", "ts"]).join(base.drop("pos"), ["well", "ts"])
    return rows.where(F.col("pressure_delta").isNotNull() & F.col("pressure_slope").isNotNull())


def event_starts(scored: DataFrame, gap_minutes: float) -> DataFrame:
    edges = rising_edges(scored.where("signal").select("well", "ts", "pos"))
    return suppress_gap(edges, gap_minutes)


__all__ = [
    "SCORED", "cause_references", "detection_records", "event_snapshot", "event_starts", "match_references",
    "rising_edges", "score_points", "suppress_gap", "uncovered",
]
