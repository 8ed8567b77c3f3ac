"""Intervals, thresholds, residual model and event matching against brute force."""

import bisect
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_grid import intervals_frame
from wellspark.functions import scalar as fn
from wellspark.operators import evaluate, events, intervals, residual, thresholds
from wellspark.schema import DAY, CauseProfile, CauseRules, DetectSettings, FeatureSettings, ResidualSettings

T0 = pd.Timestamp("2024-01-01")


def points_frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def at(minutes):
    return T0 + pd.to_timedelta(minutes, "min")


def random_intervals(seed, n, wells=2, span=3000, longest=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randrange(span)
        b = a + rng.randrange(1, longest)
        rows.append((i, i, f"w{rng.randrange(wells)}", str(at(a)), str(at(b)), "anomaly", "c"))
    return rows


def test_coverage_weights_equal_brute_force(spark):
    rows = random_intervals(1, 60)
    spans = intervals_frame(spark, rows)
    pdf = pd.DataFrame({"well": ["w0", "w1"] * 300, "ts": at(np.arange(600) * 6), "n": range(600)})
    got = intervals.weigh_points(points_frame(spark, pdf), intervals.bucketed_coverage(spans), "left")
    got = {r.n: r.weight or 0 for r in got.collect()}
    for r in pdf.itertuples():
        assert got[r.n] == sum(w == r.well and pd.Timestamp(a) <= r.ts <= pd.Timestamp(b) for _, _, w, a, b, _, _ in rows)


def test_pairs_containment_and_uncovered(spark):
    rows = random_intervals(2, 30)
    spans = intervals_frame(spark, rows)
    pdf = pd.DataFrame({"well": ["w0", "w1"] * 40, "ts": at(np.arange(80) * 40)})
    points = points_frame(spark, pdf)
    want = {(r.well, r.ts, i) for r in pdf.itertuples() for i, _, w, a, b, _, _ in rows if w == r.well and pd.Timestamp(a) <= r.ts <= pd.Timestamp(b)}
    pairs = intervals.points_in_intervals(points, spans.select("interval_id", "well", "start_ts", "end_ts"), width=3600 * 10**6)
    assert {(r.well, pd.Timestamp(r.ts), r.interval_id) for r in pairs.collect()} == want
    first = {(r.well, pd.Timestamp(r.ts)): r.interval_id for r in intervals.containing(points, spans).collect()}
    assert first == {k: min(i for w, t, i in want if (w, t) == k) for k in {(w, t) for w, t, _ in want}}
    left = {r.interval_id for r in intervals.uncovered(spans, points).collect()}
    assert left == {r[0] for r in rows} - {i for _, _, i in want}


def test_pairs_of_a_busy_bucket_come_from_short_lists(spark, monkeypatch):
    monkeypatch.setattr(intervals, "_LISTED", 4)
    rows = random_intervals(5, 80, span=300)
    spans = intervals_frame(spark, rows).select("interval_id", "well", "start_ts", "end_ts")
    pdf = pd.DataFrame({"well": ["w0", "w1"] * 30, "ts": at(np.arange(60) * 10)})
    got = intervals.points_in_intervals(points_frame(spark, pdf), spans).collect()
    want = sorted((r.well, r.ts, i) for r in pdf.itertuples() for i, _, w, a, b, _, _ in rows if w == r.well and pd.Timestamp(a) <= r.ts <= pd.Timestamp(b))
    assert sorted((r.well, pd.Timestamp(r.ts), r.interval_id) for r in got) == want


def test_pairs_of_a_busy_bucket_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(intervals, "_LISTED", 4)
    monkeypatch.setattr(intervals, "_PAIRS", 100)
    rows = random_intervals(7, 80, span=300)
    spans = intervals_frame(spark, rows).select("interval_id", "well", "start_ts", "end_ts")
    pdf = pd.DataFrame({"well": ["w0", "w1"] * 30, "ts": at(np.arange(60) * 10)})
    pairs = intervals.points_in_intervals(points_frame(spark, pdf).coalesce(1), spans)
    want = sorted((r.well, r.ts, i) for r in pdf.itertuples() for i, _, w, a, b, _, _ in rows if w == r.well and pd.Timestamp(a) <= r.ts <= pd.Timestamp(b))
    assert sorted((r.well, pd.Timestamp(r.ts), r.interval_id) for r in pairs.collect()) == want
    by_task = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 2 and max(r["count"] for r in by_task) < len(want) / 2  # two wells, a bucket each


def test_pairs_are_written_in_a_few_bits(spark, tmp_path):
    rng = np.random.default_rng(8)
    starts = rng.integers(0, 3 * DAY // 10**6, 3003)
    spans = spark.createDataFrame(pd.DataFrame({"interval_id": rng.permutation(10**6)[:3003], "well": "w", "s": starts}))
    spans = spans.select("interval_id", "well", *[F.timestamp_seconds(F.col("s") + x).cast("timestamp_ntz").alias(c) for c, x in (("start_ts", 0), ("end_ts", 86400))])
    points = spark.createDataFrame(pd.DataFrame({"well": "w", "sample": rng.permutation(10**6)[:2000], "s": rng.integers(0, 4 * DAY // 10**6, 2000)}))
    points = points.select("well", "sample", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    pairs = intervals.points_in_intervals(points, spans, width=DAY // 6).select("sample", "interval_id")
    pairs.write.parquet(str(tmp_path / "pairs"))
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 0.4 * spark.read.parquet(str(tmp_path / "pairs")).count()


def test_spans_hold_the_same_points(spark):
    rows = random_intervals(6, 200)
    times = [t for t in range(0, 3000, 60) if not 600 <= t < 2400]  # a day without any point
    pdf = pd.DataFrame({"well": "w0", "ts": at(np.array(times))})
    spans = intervals.point_spans(intervals_frame(spark, rows), points_frame(spark, pdf)).collect()
    held = {}
    for r in spans:
        inside = [t for t in pdf.ts if r.well == "w0" and pd.Timestamp(r.start_ts) <= t <= pd.Timestamp(r.end_ts)]
        assert held.setdefault(r.span, (r.well, inside)) == (r.well, inside)
    assert len(spans) == 200 and len(held) < 200


def test_clip_rules(spark):
    base = points_frame(spark, pd.DataFrame({"well": "w", "ts": at(np.arange(0, 600, 60))}))
    rules = CauseRules(anomaly=("leak", "both"), normal=("ok", "both"))
    rows = [
        (1, 1, " w ", None, None, "", " leak "),
        (2, 2, "w", "2023-01-01 00:00", "2024-01-01 02:00", "", "ok"),
        (3, 3, "w", "2024-01-01 08:00", "2025-01-01 02:00", "", "both"),
        (4, 4, "w", "2024-01-02 00:00", None, "", "leak"),
        (5, 5, "w", "2024-01-01 03:00", "2024-01-01 03:00", "", "leak"),
        (6, 6, "other", None, None, "", "leak"),
        (7, 7, "w", None, None, "", "unknown"),
        (8, 8, None, None, None, "", "leak"),
    ]
    got = intervals.reference_intervals(intervals_frame(spark, rows).drop("label"), base, rules).orderBy("row_id").collect()
    assert [(r.row_id, r.label, str(r.start_ts)[11:16], str(r.end_ts)[11:16]) for r in got] == [
        (1, "anomaly", "00:00", "09:00"),
        (2, "normal", "00:00", "02:00"),
        (3, "anomaly", "08:00", "09:00"),
    ]


def test_asof_nearest_prefers_exact_then_later(spark):
    right = points_frame(spark, pd.DataFrame({"well": "w", "ts": at(np.array([0, 100, 200, 5000]))}))
    left = points_frame(spark, pd.DataFrame({"well": ["w"] * 6, "id": range(6), "ts": at(np.array([-9, 50, 100, 149, 2600, 9999]))}))
    got = intervals.asof_nearest(left, right, "id", width=60 * 10**6 * 30)
    assert {r.id: int((pd.Timestamp(r.near_ts) - T0).total_seconds() // 60) for r in got.collect()} == {0: 0, 1: 100, 2: 100, 3: 100, 4: 5000, 5: 5000}


def test_holdout_only_groups_are_kept(spark):
    rows = [(i, i, w, "2024-01-01", "2024-01-02", "anomaly", c) for i, (w, c) in enumerate([("a", "x"), ("h", "x"), ("h", "y")])]
    spans = intervals_frame(spark, rows)
    assert {r.row_id for r in intervals.train_or_all(spans, ["h"], ["cause"]).collect()} == {0, 2}
    assert {r.row_id for r in intervals.train_or_all(spans, ["h"]).collect()} == {0}
    assert intervals.train_or_all(spans.where("well = 'h'"), ["h"]).count() == 2


def brute_threshold(values, contamination):
    """Two-sided empirical tail score, straight from the definition."""
    x = np.asarray(values)
    n = len(x)
    left = np.array([-math.log((x <= v).sum() / n) for v in x])
    right = np.array([-math.log((x >= v).sum() / n) for v in x])
    skew = np.sign(((x - x.mean()) ** 3).sum())
    sided = left if skew < 0 else right if skew > 0 else left + right
    score = np.maximum(np.maximum(left, right), sided)
    out = np.abs(x[score > np.percentile(score, 100 * (1 - contamination))])
    return out.min() if len(out) else np.abs(x).max()


@pytest.mark.parametrize("shape", ["right", "left", "constant", "even"])
def test_tail_thresholds(spark, shape):
    rng = np.random.default_rng(11)
    x = {"right": rng.exponential(1, 300), "left": -rng.exponential(1, 300), "constant": np.full(50, 2.5), "even": np.tile([-2.0, -1.0, 1.0, 2.0], 25)}[shape]
    w = rng.integers(1, 3, len(x)) if shape in ("right", "left") else np.ones(len(x), int)
    pool = spark.createDataFrame(pd.DataFrame({"feature": "f", "value": np.round(x, 3), "weight": w}))
    got = thresholds.tail_thresholds(pool, {"a": 0.01, "b": 0.05}).first()
    full = np.repeat(np.round(x, 3), w)
    np.testing.assert_allclose([got.a, got.b], [brute_threshold(full, 0.01), brute_threshold(full, 0.05)])


def test_group_thresholds_without_normal_data(spark):
    rules = CauseRules(anomaly=("x", "y", "z"), normal=("n",), pinned_slope={"g": 0.03}, inflow_fragments=("x",), leak_fragments=(),
                       profiles=(CauseProfile("x", "g", True), CauseProfile("y", "g", False), CauseProfile(" "), CauseProfile("z", "")))
    rows = [(1, 1, "a", "2024-01-01", "2024-01-02", "anomaly", "z"), (2, 2, "b", "2024-01-01", "2024-01-02", "anomaly", "x"),
            (3, 3, "b", "2024-01-01", "2024-01-02", "anomaly", "y"), (4, 4, "c", "2024-01-01", "2024-01-03", "normal", "n")]
    spans = intervals_frame(spark, rows)
    pdf = pd.DataFrame({"well": "c", "ts": at(np.arange(100) * 20), "pressure_delta": np.linspace(-1, 3, 100), "pressure_slope": np.linspace(0, 50, 100), "current_delta": 0.0, "temperature_delta": 0.0})
    feats = points_frame(spark, pdf)
    cfg = DetectSettings(causes=rules)
    got = {r.cause_group: r for r in thresholds.group_thresholds(feats, spans, spans.where("label = 'normal'"), cfg).collect()}
    assert (got["g"].thr_delta, got["g"].thr_slope, got["g"].normal_delta, got["g"].normal_slope) == (0.01, 0.03, 0.0, 0.0)
    slopes = pdf.pressure_slope[pdf.pressure_slope <= 20]
    np.testing.assert_allclose([got["z"].thr_delta, got["z"].thr_slope], [brute_threshold(pdf.pressure_delta, 0.01), brute_threshold(slopes, 0.01)])
    table = thresholds.group_thresholds(feats, spans, spans.where("label = 'normal'"), cfg)
    resolved = {r.well: r for r in thresholds.resolve_thresholds(spans, spans, table, rules).collect()}
    assert (resolved["b"].cause, resolved["b"].cause_group) == ("x", "g")
    assert (resolved["c"].cause, resolved["c"].thr_slope) == ("z", got["z"].thr_slope)
    soft = {r.well: r for r in thresholds.well_rules(spans, table, cfg).collect()}
    assert soft["b"].inflow and soft["b"].thr_slope == pytest.approx(0.018) and set(soft) == {"a", "b"}


@pytest.mark.parametrize("active", [3, 2])
def test_residual_model_ignores_outliers(spark, active):
    rng = np.random.default_rng(5)
    good = rng.multivariate_normal([1, -1, 0.5], [[1, 0.6, 0], [0.6, 1, 0.2], [0, 0.2, 1]], 800)
    bad = rng.normal(30, 1, (100, 3))
    z = np.vstack([good, bad])
    pdf = pd.DataFrame({"well": "w", "ts": at(np.arange(900)), "pressure_z": z[:, 0], "current_z": z[:, 1], "temperature_z": z[:, 2] if active == 3 else np.nan})
    feats = points_frame(spark, pdf).withColumn("temperature_z", fn.finite("temperature_z"))
    spans = intervals_frame(spark, [(1, 1, "w", str(at(0)), str(at(900)), "normal", "n")])
    model = residual.fit_residual_model(feats, spans, ResidualSettings(t2_alpha=0.2))
    assert len(model.metrics) == active
    np.testing.assert_allclose(model.location, [1, -1, 0.5][:active], atol=0.15)
    cov = np.linalg.inv(np.array(model.precision))
    np.testing.assert_allclose(cov, np.cov(good[:, :active].T), atol=0.25)
    scored = feats.withColumn("t2", residual.t2_score(model)).toPandas()
    assert (scored.t2[800:] > model.threshold).all() and (scored.t2[:800] > model.threshold).mean() < 0.15
    assert residual.fit_residual_model(feats, spans, ResidualSettings(min_points=5000)) is None
    assert residual.fit_residual_model(feats, spans, ResidualSettings(enabled=False)) is None
    flat = feats.withColumn("current_z", F.lit(1.0))
    assert residual.fit_residual_model(flat, spans, ResidualSettings()) is None


@pytest.mark.parametrize("seed", range(3))
def test_first_open_equals_brute_force(spark, seed):
    """Slices of two hours, so that most intervals cover many of them; ends that touch; copies."""
    rng = random.Random(seed)
    rows = random_intervals(seed, 40, span=1500, longest=40) + [(i + 40, i + 40, *r[2:]) for i, r in enumerate(random_intervals(seed + 9, 12, span=1500, longest=1500))]
    rng.shuffle(rows)
    rows = [(i, i, *r[2:]) for i, r in enumerate(rows)]
    rows += [(60, 60, *rows[0][2:]), (61, 61, "w0", "2023-12-31", "2023-12-31", "anomaly", "c"), (62, 62, "w1", "2023-12-20", "2024-02-01", "anomaly", "c")]
    segments = intervals.first_open(intervals_frame(spark, rows), width=120 * 60 * 10**6).collect()
    micros = lambda t: int(pd.Timestamp(t).value // 1000)
    spans = [(i, w, micros(a), micros(b)) for i, _, w, a, b, _, _ in rows]
    for well in ("w0", "w1"):
        own = sorted((s.seg_start, s.seg_end, s.row_id) for s in segments if s.well == well)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))
        ends = sorted({x + d for _, w, a, b in spans if w == well for x in (a, b) for d in (-1, 0, 1)})
        for t in ends:
            want = min((i for i, w, a, b in spans if w == well and a <= t <= b), default=None)
            assert next((i for a, b, i in own if a <= t <= b), None) == want
    assert intervals.first_open(intervals_frame(spark, rows[:1]).where("row_id < 0")).count() == 0


def test_long_chains_of_edges(spark):
    """A chain of pointers over many slices, and a run without an end."""
    times = [*range(0, 200_000, 50), *range(300_000, 300_500, 7)]
    want, last = [], None
    for t in times:
        if last is None or t - last >= 120:
            last = t
            want.append(t)
    edges = points_frame(spark, pd.DataFrame({"well": "w", "ts": at(np.array(times)), "pos": np.arange(len(times)) * 3}))
    got = sorted(int((pd.Timestamp(r.ts) - T0).total_seconds() // 60) for r in events.suppress_gap(edges, 120).collect())
    assert got == want


def test_edges_and_gap(spark):
    rng = np.random.default_rng(3)
    rows, want_edges, want_kept = [], [], []
    for w in range(3):
        signal = rng.random(600) < 0.35
        times = np.cumsum(rng.integers(5, 60, 600))
        last = None
        for i in range(600):
            if signal[i]:
                rows.append((f"w{w}", at(int(times[i])), i + 1))
                if i == 0 or not signal[i - 1]:
                    want_edges.append((f"w{w}", at(int(times[i]))))
                    if last is None or times[i] - last >= 240:
                        last = times[i]
                        want_kept.append((f"w{w}", at(int(times[i]))))
    df = points_frame(spark, pd.DataFrame(rows, columns=["well", "ts", "pos"]))
    edges = events.rising_edges(df)
    assert sorted((r.well, pd.Timestamp(r.ts)) for r in edges.collect()) == sorted(want_edges)
    kept = events.suppress_gap(edges, 240)
    assert sorted((r.well, pd.Timestamp(r.ts)) for r in kept.collect()) == sorted(want_kept)
    assert events.suppress_gap(edges, 0).count() == len(want_edges)


def test_matching_moves_few_entries(monkeypatch):
    """No list that grows with a well's references is inserted into or deleted from."""
    longest = 0

    def insort(found, value):
        nonlocal longest
        longest = max(longest, len(found))
        bisect.insort(found, value)

    monkeypatch.setattr(events, "insort", insort)
    n, columns = 6000, ["well", "kind", "ord", "contain_id", "interval_id", "start_us", "end_us", "near_us", "most_lead"]
    starts = [int(s) for s in np.random.default_rng(5).permutation(n) * 10]
    rows = [("w", 0, i, -1, i, s, s + 5, s + 1, 0) for i, s in enumerate(starts)]
    rows += [("w", 1, s, -1, 0, 0, 0, 0, 10) for s in range(0, 10 * n, 40)]
    found = pd.concat(events._match_wells(iter([pd.DataFrame(rows, columns=columns)])))
    assert sorted(found["interval_id"]) == list(range(n)) and (~found["supplemental"]).sum() == n // 4
    assert longest <= events._Times.BLOCK


def naive_match(points, refs, starts, rule):
    """All references scanned for every event, in order."""
    taken, found, times = set(), [], []

    def attempt(t, supplemental):
        p = points[t]
        if p["delta"] is None or p["slope"] is None:
            return
        inside = [r for r in refs if r["start"] <= t <= r["end"]]
        if inside:
            ref = inside[0]
        else:
            free = [r for r in refs if (r["start"], r["end"]) not in taken]
            if not free:
                return
            ref = min(free, key=lambda r: abs(t - r["start"]))
        lead = ref["start"] - t
        d, s = abs(p["delta"]), abs(p["slope"])
        if lead > 0 and rule["inflow"] and not (lead <= 720 and p["flag"] and s >= 3 * rule["slope"] and d >= 3 * rule["delta"]):
            return
        if lead > 0 and rule["leak"] and not (p["flag"] and (s >= 0.6 * rule["slope"] or d >= max(0.5 * rule["delta"], 0.01))):
            return
        key = (ref["start"], ref["end"])
        if key not in taken:
            taken.add(key)
            times.append(t)
            found.append((t, key, supplemental))

    for t in starts:
        attempt(t, False)
    if not rule["holdout"]:
        grid = sorted(points)
        for r in refs:
            if not any(r["start"] <= t <= r["end"] for t in times):
                attempt(min(grid, key=lambda g: (abs(g - r["start"]), -g)), True)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_matching_equals_naive_scan(spark, seed):
    rng = random.Random(seed)
    kinds = {"in": (True, False, False), "leak": (False, True, False), "other": (False, False, False), "held": (False, False, True)}
    points, refs, starts, want = [], [], [], set()
    next_id = 0
    for well, (inflow, leak, holdout) in kinds.items():
        own = {}
        for t in range(0, 6000, 15):
            own[t] = {"delta": rng.choice([None, rng.uniform(-0.4, 0.4)]) if rng.random() < 0.2 else rng.uniform(-0.4, 0.4), "slope": rng.uniform(-0.4, 0.4), "flag": rng.random() < 0.5}
            points.append((well, at(t), own[t]["delta"], own[t]["slope"], own[t]["flag"]))
        mine = []
        for _ in range(rng.randrange(3, 14)):
            a = rng.randrange(0, 5900)
            b = a + rng.randrange(1, 500)
            mine.append({"id": next_id, "start": a, "end": b})
            next_id += 1
            if rng.random() < 0.15:
                mine.append({"id": next_id, "start": a, "end": b})
                next_id += 1
        refs += [(r["id"], r["id"], well, str(at(r["start"])), str(at(r["end"])), "anomaly", "c") for r in mine]
        at_times = sorted(rng.sample(sorted(own), 30))
        starts += [(well, at(t)) for t in at_times]
        rule = {"inflow": inflow, "leak": leak, "holdout": holdout, "delta": 0.1, "slope": 0.1}
        want |= {(well, at(t), at(k[0]), at(k[1]), s) for t, k, s in naive_match(own, mine, at_times, rule)}
    schema = "well string, ts timestamp, pressure_delta double, pressure_slope double, spike_flag boolean"
    scored = spark.createDataFrame([(w, t.to_pydatetime(), d, s, f) for w, t, d, s, f in points], schema)
    scored = scored.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "ewma_flag": F.lit(False), "residual_flag": F.lit(False)})
    rules = spark.createDataFrame([(w, i, l, h, 0.1, 0.1) for w, (i, l, h) in kinds.items()], "well string, inflow boolean, leak boolean, holdout boolean, thr_delta double, thr_slope double")
    spans = intervals_frame(spark, refs)
    starts = points_frame(spark, pd.DataFrame(starts, columns=["well", "ts"]))
    got = events.match_references(starts, spans, scored, rules, DetectSettings())
    got = got.join(spans.select("interval_id", "start_ts", "end_ts"), "interval_id").collect()
    assert {(r.well, pd.Timestamp(r.ts), pd.Timestamp(r.start_ts), pd.Timestamp(r.end_ts), r.supplemental) for r in got} == want
    assert len(got) == len(want)


def test_scalar_rules(spark):
    row = spark.range(1).select(
        fn.safe_divide(F.lit(1.0), F.lit(0.0)).alias("zero"),
        fn.base_signal(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("missing"),
        fn.base_signal(fn.finite(F.lit(float("nan"))), F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("nan"),
        *[fn.direction(F.lit(v).cast("double")).alias(n) for n, v in (("a", 0.1), ("b", 0.03), ("c", -0.1), ("d", -0.03), ("e", 0.0), ("f", None))],
        fn.floor_div(F.lit(-1).cast("bigint"), 10).alias("down"),
        fn.overlaps(F.lit(1), F.lit(2), F.lit(2), F.lit(3)).alias("touch"),
    ).first()
    assert (row.zero, row.missing, row.nan, row.down, row.touch) == (None, False, False, -1, True)
    assert [row.a, row.b, row.c, row.d, row.e, row.f] == ["↑↑", "↑", "↓↓", "↓", "=", "?"]
    assert fn.label_set(None, ["d"]) == ("d",) and fn.label_set(" x ") == ("x",) and fn.label_set([" a", None, "", "a", 5]) == ("a", "5")


def test_first_trigger_edges(spark):
    pdf = pd.DataFrame({"well": "w", "ts": at(np.arange(10) * 15), "pos": np.arange(1, 11), "pressure_delta": [0.5, 0.5, 0.0, 0.0, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0], "current_delta": 0.1, "temperature_delta": 0.2})
    pdf["pressure_slope"] = 1.0
    rules = spark.createDataFrame([("w", 0.1, 0.1)], "well string, thr_delta double, thr_slope double")
    spans = [(1, "w", 30, 135), (2, "w", 90, 135), (3, "other", 0, 60), (4, "w", 60, 60)]
    spans = intervals_frame(spark, [(i, i, w, str(at(a)), str(at(b)), "anomaly", "c") for i, w, a, b in spans])
    got = {r.interval_id: r for r in evaluate.first_triggers(points_frame(spark, pdf), spans, rules, FeatureSettings(30, 15, 30)).collect()}
    assert (got[1].evaluated_points, got[1].delay_minutes, got[1].triggers.pressure_delta) == (10, 30.0, 0.5)
    assert (got[2].evaluated_points, got[2].detection_start, got[2].triggers) == (6, None, None)
    assert (got[3].evaluated_points, got[4].evaluated_points, got[4].delay_minutes) == (0, 3, 0.0)
