"""Live detection: rows in any order within the delay give what sorted rows give; later ones are counted."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wellspark.streaming.detector import detect_stream

T0 = pd.Timestamp("2024-01-01")
W, S, MP, GAP = 4, 2, 2, 60


def naive(times, values):
    """Events of one well, row by row."""
    found, before, was, event = [], None, False, None
    for i in range(len(values)):
        def mean(end):
            own = [v for v in values[max(0, end - W + 1) : end + 1] if not np.isnan(v)] if end >= 0 else []
            return sum(own) / len(own) if len(own) >= MP else None

        now, previous = mean(i), mean(i - S)
        before = before if previous is None else previous
        slope = values[i] - values[i - S] if i >= S else np.nan
        delta = (now - before) / before if now is not None and before else np.nan
        fires = abs(delta) >= 0.05 and abs(slope) >= 1
        if fires and not was and (event is None or times[i] - event >= GAP):
            event = times[i]
            found.append(times[i])
        was = fires
    return found


def run(spark, folder, batches, delay):
    """Events and late rows as (well, minutes), one stream run per batch on the same progress."""
    rules = spark.createDataFrame([(w, 0.05, 1.0, W, S, MP) for w in ("a", "b")], "well string, thr_delta double, thr_slope double, w int, s int, mp int")
    baseline = spark.createDataFrame([], "metric string, bin_index bigint, frequency_center double, count bigint, median double, mad double")
    schema = "well string, ts timestamp_ntz, Intake_Pressure double, Frequency double"
    for part in batches:
        df = spark.createDataFrame(part).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.repartition(2).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        found = detect_stream(stream, baseline, rules, 20.0, GAP, delay)
        writer = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{folder}/out").collect()
    out = {"event": [], "late": []}
    for r in rows:
        out[r["kind"]].append((r["well"], int((pd.Timestamp(r["ts"]) - T0).total_seconds() // 60)))
    return {k: sorted(v) for k, v in out.items()}


def test_order_and_late_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    parts, want = [], []
    for well in ("a", "b"):
        times = np.arange(0, 2400, 15)
        values = 50 + np.round(rng.normal(0, 3, len(times)), 2) + 20 * (rng.random(len(times)) < 0.1)
        values[rng.random(len(times)) < 0.2] = np.nan
        parts.append(pd.DataFrame({"well": well, "minute": times, "ts": T0 + pd.to_timedelta(times, "min"), "Intake_Pressure": values, "Frequency": np.nan}))
        taken = times <= times[-1] - 120
        want += [(well, t) for t in naive(times[taken].tolist(), values[taken].tolist())]
    rows = pd.concat(parts)
    assert len(want) > 5
    # Rows come up to 120 minutes late, over five batches; two more come too late and are counted.
    arrival = rows["minute"] + rng.integers(0, 120, len(rows))
    arrival[rows["minute"] == 2385] = 2385
    batches = [rows[(arrival >= a) & (arrival < b)] for a, b in ((0, 500), (500, 1000), (1000, 1700), (1700, 2390), (2390, 9999))]
    lost = pd.DataFrame({"well": ["a", "b"], "ts": [T0 + pd.Timedelta(minutes=7), T0 + pd.Timedelta(minutes=100)], "Intake_Pressure": 9.0, "Frequency": 1.0})
    batches = [pd.concat([b.drop(columns="minute"), lost.iloc[:0]]) for b in batches if len(b)]
    batches[2] = pd.concat([batches[2], lost])
    found = run(spark, str(tmp_path), batches, 120)
    assert found["late"] == [("a", 7), ("b", 100)]
    assert found["event"] == sorted(want)
