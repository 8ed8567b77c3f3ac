"""Alignment, cleaning and features against pandas primitives."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wellspark.operators import align, clean, features, ordering
from wellspark.operators.baseline import build_baseline
from wellspark.schema import (
    DAY,
    METRICS,
    AlignSettings,
    BaselineSettings,
    CleanSettings,
    FeatureSettings,
    frequency_micros,
)


def telemetry(spark, rows):
    schema = "well string, metric string, ts string, value double, row_id long"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def random_samples(seed=0, wells=("a", "b"), n=300):
    rng = np.random.default_rng(seed)
    parts = []
    for w in wells:
        for m in METRICS:
            minutes = np.sort(rng.choice(60 * 24 * 9, n, replace=False)) + rng.integers(0, 300)
            parts.append(
                pd.DataFrame(
                    {"well": w, "metric": m, "ts": pd.Timestamp("2024-03-01 07:10") + pd.to_timedelta(minutes, "min"), "value": np.round(rng.gamma(2, 20, n), 2)}
                )
            )
    pdf = pd.concat(parts, ignore_index=True)
    pdf["row_id"] = np.arange(len(pdf))
    return pdf


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def expected_base(pdf, freq, agg="mean"):
    """The grid frame of one well by pandas resampling."""
    series = {m: g.set_index("ts")["value"].sort_index() for m, g in pdf.groupby("metric")}
    start, end = max(s.index.min() for s in series.values()), min(s.index.max() for s in series.values())
    clipped = {m: s[(s.index >= start) & (s.index <= end)] for m, s in series.items()}
    base = pd.concat({m: s.resample(freq).agg(agg).loc[start:end] for m, s in clipped.items()}, axis=1).dropna(how="all")
    p = clipped["Intake_Pressure"].resample(freq)
    extrema = pd.concat({"Intake_Pressure_min": p.min().loc[start:end], "Intake_Pressure_max": p.max().loc[start:end]}, axis=1)
    return pd.concat([base, extrema], axis=1).sort_index()


@pytest.mark.parametrize("freq,agg", [("15min", "mean"), ("6h", "median"), ("7h", "max"), ("2D", "min"), ("45min", "mean")])
def test_base_equals_pandas(spark, freq, agg):
    pdf = random_samples()
    got = align.build_base(to_spark(spark, pdf), AlignSettings(freq, agg)).orderBy("well", "ts").toPandas()
    for well, own in got.groupby("well"):
        want = expected_base(pdf[pdf.well == well], freq, agg)
        assert own["ts"].tolist() == want.index.tolist()
        assert own["pos"].tolist() == list(range(1, len(want) + 1))
        for c in want.columns:
            np.testing.assert_allclose(own[c].astype(float), want[c], rtol=1e-12)


def test_base_in_short_slices_is_the_same(spark, monkeypatch):
    pdf = random_samples(seed=4)
    whole = align.build_base(to_spark(spark, pdf), AlignSettings("15min"))
    monkeypatch.setattr(align, "_SLICE_STEPS", 16)
    sliced = align.build_base(to_spark(spark, pdf), AlignSettings("15min"))
    assert whole.exceptAll(sliced).isEmpty() and sliced.exceptAll(whole).isEmpty()


def test_samples_are_exchanged_once(spark):
    clipped = to_spark(spark, random_samples(seed=4)).withColumns({c: F.col("ts") for c in ("range_start", "range_end")})
    plan = align.resample(clipped, AlignSettings("15min"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_dedup_range_and_first_partial_bin(spark):
    rows = [
        ("w", "Intake_Pressure", "2024-01-01 00:05:00", 1.0, 1),
        ("w", "Intake_Pressure", "2024-01-01 00:20:00", 2.0, 2),
        ("w", "Intake_Pressure", "2024-01-01 00:20:00", 9.0, 3),
        ("w", "Intake_Pressure", "2024-01-01 01:20:00", 4.0, 4),
        ("w", "Current", "2024-01-01 00:05:00", 5.0, 5),
        ("w", "Current", "2024-01-01 01:31:00", 6.0, 6),
        ("w", "Current", "2024-01-01 01:10:00", float("nan"), 7),
        ("single", "Current", "2024-01-01 01:31:00", 6.0, 8),
        ("apart", "Current", "2024-01-01 01:00:00", 6.0, 9),
        ("apart", "Current", "2024-01-01 02:00:00", 6.0, 10),
        ("apart", "Frequency", "2024-01-01 03:00:00", 6.0, 11),
        ("apart", "Frequency", "2024-01-01 04:00:00", 6.0, 12),
    ]
    base = align.build_base(telemetry(spark, rows), AlignSettings("15min")).orderBy("ts").collect()
    assert {r.well for r in base} == {"w"}
    assert [r.ts.strftime("%H:%M") for r in base] == ["00:15", "00:30", "00:45", "01:00", "01:15"]
    assert [r.Intake_Pressure for r in base] == [9.0, None, None, None, 4.0]
    assert all(r.Current is None for r in base)


def test_no_frequency_passes_samples_through(spark):
    pdf = random_samples(n=40)
    base = align.build_base(to_spark(spark, pdf), AlignSettings(""))
    assert set(base.columns) == {"well", "ts", "pos", *METRICS}
    assert base.select(F.sum(sum((F.col(m).isNotNull().cast("int") for m in METRICS), F.lit(0)))).first()[0] == align.aligned_samples(to_spark(spark, pdf)).count()


def test_frequency_text():
    assert [frequency_micros(t) for t in ("15T", "15min", "6h", "30s", "1D", "D")] == [9e8, 9e8, 216e8, 3e7, 864e8, 864e8]
    with pytest.raises(ValueError):
        frequency_micros("soon")


def gappy(seed=5, wells=3, n=250, minutes=(15,)):
    rng = np.random.default_rng(seed)
    parts = []
    for w in range(wells):
        step = minutes[w % len(minutes)]
        p = {m: np.round(rng.gamma(2, 20, n), 2) for m in METRICS}
        for m in METRICS:
            p[m][rng.random(n) < 0.25] = np.nan
        pdf = pd.DataFrame(p)
        pdf.insert(0, "ts", pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * step, "min"))
        pdf.insert(0, "well", f"w{w}")
        pdf["Intake_Pressure_min"], pdf["Intake_Pressure_max"] = pdf["Intake_Pressure"] - 1, pdf["Intake_Pressure"] + 1
        parts.append(pdf)
    return pd.concat(parts, ignore_index=True)


def base_frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    values = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns if c not in ("well", "ts")]
    return ordering.positions(df.select("well", F.col("ts").cast("timestamp_ntz").alias("ts"), *values), ["well"], "ts", DAY)


def pandas_clean(pdf, points, limit, n_sigma=3.0):
    out = pdf.copy()
    for m in METRICS:
        roll = pdf[m].rolling(points, center=True, min_periods=1).median()
        away = (pdf[m] - roll).abs()
        bad = away > n_sigma * 1.4826 * away.rolling(points, center=True, min_periods=1).median()
        out[f"{m}_outlier"] = bad
        out.loc[bad, m] = np.nan
        if m == "Intake_Pressure":
            out.loc[bad, ["Intake_Pressure_min", "Intake_Pressure_max"]] = np.nan
        out[m] = out[m].ffill(limit=limit)
    return out


def short_blocks(monkeypatch):
    for f in (ordering.with_halo, ordering.own_rows, ordering.on_blocks):
        monkeypatch.setattr(f, "__defaults__", tuple(32 if v == 8192 else v for v in f.__defaults__))


def frame_points(minutes, step):
    points = max(round(minutes / step), 3)
    return points + 1 - points % 2


STEPS = {"one block": (15, 5, 30), "blocks": (15, 5, 30), "ten steps": (1, 2, 3, 4, 5, 6, 10, 15, 20, 30)}


@pytest.mark.parametrize("path", STEPS)
def test_clean_equals_pandas(spark, monkeypatch, path):
    minutes = STEPS[path]
    pdf = gappy(minutes=minutes, wells=len(minutes), n=250 if path != "ten steps" else 90)
    sizes = {m: (frame_points(60, m), round(30 / m)) for m in minutes}
    assert path == "ten steps" or sizes == {15: (5, 2), 5: (13, 6), 30: (3, 1)}  # 60 and 30 minutes as odd points and rows
    if path != "one block":
        short_blocks(monkeypatch)
    got = clean.clean(base_frame(spark, pdf), CleanSettings(60, 3.0, 30)).orderBy("well", "ts").toPandas()
    for i, (well, own) in enumerate(got.groupby("well")):
        want = pandas_clean(pdf[pdf.well == well].reset_index(drop=True), *sizes[minutes[i]])
        for c in (*METRICS, "Intake_Pressure_min", "Intake_Pressure_max"):
            np.testing.assert_allclose(own[c].astype(float), want[c], err_msg=f"{well} {c}")
        for m in METRICS:
            assert own[f"{m}_outlier"].tolist() == want[f"{m}_outlier"].tolist()


def test_constant_series_flags_any_deviation_and_inactive_cleaning(spark):
    pdf = gappy(wells=1, n=9)
    for m in METRICS:
        pdf[m] = 5.0
    pdf.loc[4, "Current"] = 5.01
    got = clean.clean(base_frame(spark, pdf), CleanSettings(45, 3.0, 0)).orderBy("ts").toPandas()
    assert got["Current_outlier"].tolist() == [i == 4 for i in range(9)]
    assert pd.isna(got["Current"][4])  # fill limit 0: nothing is filled
    same = clean.clean(base_frame(spark, pdf), CleanSettings(0, 3.0, 30))
    assert same.where("Current_outlier or Current_filled").isEmpty()


def pandas_delta(x, ts, w, s, mp):
    now = x.rolling(w, min_periods=mp).mean()
    before = x.shift(s).rolling(w, min_periods=mp).mean()
    before.index = now.index = ts
    before = before.interpolate(method="time")
    return ((now - before) / before.replace(0, np.nan)).replace([np.inf, -np.inf], np.nan).to_numpy()


@pytest.mark.parametrize("path", STEPS)
def test_features_equal_pandas(spark, monkeypatch, path):
    minutes = STEPS[path]
    pdf = gappy(seed=8, minutes=minutes, wells=len(minutes), n=250 if path != "ten steps" else 90)
    if path != "one block":
        short_blocks(monkeypatch)
    cfg = FeatureSettings(60, 30, 30)
    got = features.feature_frame(base_frame(spark, pdf), None, cfg).orderBy("well", "ts").toPandas()
    names = {"pressure": "Intake_Pressure", "current": "Current", "temperature": "Motor_Temperature"}
    for well, own in got.groupby("well"):
        src = pdf[pdf.well == well].reset_index(drop=True)

        def sizes(m):
            step = src["ts"][src[m].notna()].diff().median().total_seconds() / 60
            w = max(1, round(60 / step))
            return w, max(1, round(30 / step)), max(1, math.ceil(w * 0.5))

        for n, m in names.items():
            w, s, mp = sizes(m)
            np.testing.assert_allclose(own[f"{n}_delta"].astype(float), pandas_delta(src[m], src["ts"], w, s, mp), rtol=1e-9, atol=1e-9, err_msg=f"{well} {n}")
        s = sizes("Intake_Pressure")[1]
        np.testing.assert_allclose(own["pressure_slope"].astype(float), src["Intake_Pressure"] - src["Intake_Pressure"].shift(s))
        assert own[["pressure_expected", "pressure_scale", "pressure_z"]].isna().all().all()


def intervals_frame(spark, rows):
    schema = "interval_id long, row_id long, well string, start_ts string, end_ts string, label string, cause string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")}).withColumn("notes", F.array().cast("array<string>"))


def test_baseline_counts_overlaps_twice_and_scales(spark):
    pdf = gappy(seed=2, wells=2)
    base = base_frame(spark, pdf)
    spans = [("w0", "2024-01-01 00:00", "2024-01-02 12:00"), ("w0", "2024-01-01 10:00", "2024-01-02 00:00"), ("w1", "2024-01-01 05:00", "2024-01-02 05:00")]
    normal = intervals_frame(spark, [(i, i, *s, "normal", "n") for i, s in enumerate(spans)])
    cfg = BaselineSettings(bin_width=20.0, min_points=8)
    got = {(r.metric, r.bin_index): r for r in build_baseline(base, normal, cfg).collect()}
    inside = pd.concat([pdf[(pdf.well == w) & (pdf.ts >= a) & (pdf.ts <= b)] for w, a, b in spans])
    want = {}
    for m in ("Intake_Pressure", "Current", "Motor_Temperature"):
        ok = inside.dropna(subset=[m, "Frequency"])
        for k, v in ok.groupby(np.floor(ok["Frequency"] / 20.0))[m]:
            if len(v) >= 8:
                want[(m, int(k))] = (len(v), v.median(), max(1.4826 * (v - v.median()).abs().median(), 1e-6))
    assert set(got) == set(want)
    for k, (n, median, mad) in want.items():
        assert got[k]["count"] == n
        np.testing.assert_allclose([got[k]["median"], got[k]["mad"]], [median, mad], rtol=1e-12)

    baseline = build_baseline(base, normal, cfg)
    rows = features.feature_frame(base, baseline, FeatureSettings(60, 30, 30), cfg).toPandas()
    assert (rows["pressure_scale"].dropna() >= 0.05).all() and rows["pressure_scale"].notna().all()
    hit = rows["pressure_expected"].notna()
    np.testing.assert_allclose(rows["pressure_residual"][hit], rows["pressure"][hit] - rows["pressure_expected"][hit])
    np.testing.assert_allclose(rows["pressure_residual"][~hit], rows["pressure"][~hit])
    nothing = build_baseline(base, normal, BaselineSettings(bin_width=0))
    assert nothing.isEmpty()
