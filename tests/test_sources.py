"""Files, payloads, sinks and streams."""

import json

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_grid import random_samples, to_spark
from wellspark.operators import align
from wellspark.plans.detection import Detection
from wellspark.schema import AlignSettings, DetectSettings
from wellspark.sources import annotations, cells, payload, sinks, telemetry
from wellspark.streaming.detector import detect_stream
from wellspark.streaming.resample import resample_stream


def test_wide_csv(spark, tmp_path):
    (tmp_path / "1128г.csv").write_text(
        "timestamp_Intake_Pressure,Intake_Pressure,timestamp_Current,Current,timestamp_Alone\n"
        "01.02.2024 10:00,5.5,2024-02-01 10:01:00,bad,x\n01.02.2024 10:00,6.5,,,\n,,03/02/2024,7,\n"
    )
    (tmp_path / "svod.csv").write_text("timestamp_Intake_Pressure,Intake_Pressure,timestamp_Current,Current,timestamp_Alone\n1.1.2024,1,,,\n")
    got = telemetry.unpivot_telemetry(telemetry.read_wide(spark, str(tmp_path))).orderBy("metric", "row_id")
    rows = [(r.well, r.metric, str(r.ts), r.value) for r in got.collect()]
    assert rows == [
        ("1128г", "Current", "2024-02-01 10:01:00", None),
        ("1128г", "Current", "2024-02-03 00:00:00", 7.0),
        ("1128г", "Intake_Pressure", "2024-02-01 10:00:00", 5.5),
        ("1128г", "Intake_Pressure", "2024-02-01 10:00:00", 6.5),
    ]
    last = align.dedup_last(align.valid_samples(got)).where("metric = 'Intake_Pressure'").collect()
    assert [r.value for r in last] == [6.5]


def test_wide_csv_with_own_headers(spark, tmp_path):
    (tmp_path / "A.csv").write_text("timestamp_Current,Current,timestamp_Intake_Pressure,Intake_Pressure\n2024-02-01 10:00,1,2024-02-01 10:00,100\n")
    (tmp_path / "B.csv").write_text("timestamp_Intake_Pressure,Intake_Pressure,timestamp_Current,Current\r\n2024-02-01 11:00+03:00,100,2024-02-01 11:00,1\r\n")
    (tmp_path / "C.csv").write_text(
        'timestamp_Motor_Temperature,Motor_Temperature,timestamp_Vibration,Vibration,"timestamp_Intake_Pressure",Intake_Pressure\n'
        '2024-02-01T12:00:00-01:30,70,"2024-02-01 12:00","0.5",2024-02-01 12:00:00Z,100\n'
    )
    got = telemetry.unpivot_telemetry(telemetry.read_wide(spark, str(tmp_path)))
    assert sorted((r.well, r.metric, str(r.ts)[11:16], r.value) for r in got.collect()) == [
        ("A", "Current", "10:00", 1.0),
        ("A", "Intake_Pressure", "10:00", 100.0),
        ("B", "Current", "11:00", 1.0),
        ("B", "Intake_Pressure", "08:00", 100.0),
        ("C", "Intake_Pressure", "12:00", 100.0),
        ("C", "Motor_Temperature", "13:30", 70.0),
        ("C", "Vibration", "12:00", 0.5),
    ]


def test_annotation_comments_in_any_column(spark, tmp_path):
    c = annotations.AnnotationColumns()
    blank = "," * 60
    (tmp_path / "svod.csv").write_text(f'title\n\n{c.well},{c.cause},{c.start},{c.end}{blank}\n1,"leak, big",01.02.2024,02.02.2024,first{"," * 58},"the ""last"""\n')
    (row,) = annotations.read_annotations(annotations.read_cells(spark, str(tmp_path))).collect()
    assert (row.well, row.cause, row.notes) == ("1", "leak, big", ["first", 'the "last"'])


def test_annotation_csv(spark, tmp_path):
    c = annotations.AnnotationColumns()
    (tmp_path / "svod.csv").write_text(
        f"title,,,,,\n,,,,,\n{c.well},{c.cause},{c.start},{c.end},,Unnamed: 5\n"
        "495,leak,01.02.2024 10:00,02.02.2024, first ,\n,,bad,03.02.2024 11:30,,second\n7,,,,,\n"
    )
    got = annotations.read_annotations(annotations.read_cells(spark, str(tmp_path))).orderBy("row_id").collect()
    assert [(r.well, r.cause, str(r.start_ts), str(r.end_ts), r.notes) for r in got] == [
        ("495", "leak", "2024-02-01 10:00:00", "2024-02-02 00:00:00", ["first"]),
        ("495", "leak", "None", "2024-02-03 11:30:00", ["second"]),
        ("7", "leak", "None", "None", []),
    ]


SHEETS = {"svod": [{"Скв": "1", "ПричОст": "leak", "Unnamed: 4": " n "}, {"Скв": None}], "1": [{"timestamp_V": "1.2.2024", "V": 2.5}]}


@pytest.mark.parametrize("shape", ["described", "listed", "columns", "bare", "nested"])
def test_payload_shapes(spark, tmp_path, shape):
    described = [{"name": k, "records": v} for k, v in SHEETS.items()]
    columns = {k: {c: {str(i): r[c] for i, r in enumerate(v) if c in r} for c in v[0]} for k, v in SHEETS.items()}
    doc = {"described": {"sheets": described}, "listed": SHEETS, "columns": columns, "bare": described, "nested": {"a": {"b": SHEETS}}}[shape]
    (tmp_path / "doc.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1))
    path = ["a", "b"] if shape == "nested" else None
    rows = payload.sheets_from_json(payload.read_payloads(spark, str(tmp_path)), payload_path=path)
    found = annotations.annotations_from_records(rows).orderBy("row_id").collect()
    assert [(r.well, r.cause, r.notes) for r in found] == [("1", "leak", ["n"]), ("1", "leak", [])]
    samples = telemetry.telemetry_from_records(rows).collect()
    assert [(r.well, r.metric, str(r.ts), r.value) for r in samples] == [("1", "V", "2024-02-01 00:00:00", 2.5)]


@pytest.mark.parametrize("doc", ['{"a": 1}', '[{"records": []}]', '[{"name": ""}]', "[3]", "{}", "[]", "5", '{"sheets": []}'])
def test_payload_errors(spark, doc):
    with pytest.raises(PySparkException):
        payload.sheets_from_json(spark.createDataFrame([(1, doc)], "payload_id int, value string")).collect()


def test_sinks_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", float("nan"))], "well string, x double").withColumn("start", F.lit("2024-01-01 10:00:00.5").cast("timestamp_ntz"))
    sinks.write_json(rows, str(tmp_path / "j"))
    lines = [json.loads(t.value) for t in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(lines, key=lambda r: r["well"]) == [{"well": "a", "x": 1.5, "start": "2024-01-01T10:00:00.500000"}, {"well": "b", "x": None, "start": "2024-01-01T10:00:00.500000"}]
    sinks.write_both(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == spark.read.option("header", True).csv(str(tmp_path / "t.csv")).count() == 2
    assert sinks.settings_table(spark, DetectSettings()).where("section = 'features'").count() == 3


def test_detections_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "anomaly"), (2, "anomaly"), (1, "normal")], "well int, segment_type string").write.parquet(str(tmp_path / "d"))
    got = telemetry.load_detections(spark, str(tmp_path / "d"), ["1"])
    assert [tuple(r) for r in got.collect()] == [("1", "anomaly")]
    assert "EqualTo(segment_type,anomaly)" in got._jdf.queryExecution().toString()


def test_stream_bins_equal_batch_bins(spark, tmp_path):
    pdf = random_samples(seed=9, n=120)
    days = pdf["ts"].dt.day
    for day in sorted(days.unique()):
        to_spark(spark, pdf[days == day]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    bins = resample_stream(live, "6 hours", "30 days")
    query = bins.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema(bins.schema).parquet(str(tmp_path / "out")).isEmpty()  # nothing is final within the lateness

    bins = resample_stream(live, "6 hours", "3 days")
    query = bins.writeStream.format("parquet").option("path", str(tmp_path / "out2")).option("checkpointLocation", str(tmp_path / "c2"))
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r.well, r.metric, r.ts): round(r.value, 9) for r in spark.read.schema(bins.schema).parquet(str(tmp_path / "out2")).collect()}
    want = {(w, m, t.to_pydatetime()): round(v, 9) for (w, m, t), v in pdf.groupby(["well", "metric", pdf["ts"].dt.floor("6h")])["value"].mean().items()}
    assert got and all(want[k] == v for k, v in got.items())
    horizon = pdf["ts"].max() - pd.Timedelta("3D")
    assert {k for k in want if k[2] + pd.Timedelta("6h") <= horizon} <= set(got)


def test_stream_detector_equals_batch_edges(spark, tmp_path):
    pdf = pd.DataFrame({"well": "w", "ts": pd.date_range("2024-01-01", periods=200, freq="15min")})
    pdf["Intake_Pressure"] = [50.0 + (30 if i % 37 in (5, 6, 7, 20) else 0) + (i % 3) for i in range(200)]
    pdf["Frequency"] = 50.0
    baseline = spark.createDataFrame([("Intake_Pressure", 0, 50.0, 10, 1000.0, 1.0)], "metric string, bin_index long, frequency_center double, count long, median double, mad double")
    rules = spark.createDataFrame([("w", 0.05, 5.0, 2, 1, 2)], "well string, thr_delta double, thr_slope double, w int, s int, mp int")
    for part in (pdf[:70], pdf[70:71], pdf[71:]):
        to_spark(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = detect_stream(live, baseline, rules, 2.0, 60)
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted(r.ts for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect())

    x = pdf["Intake_Pressure"]
    now, before = x.rolling(2).mean(), x.shift(1).rolling(2).mean()
    fires = ((((now - before) / before).abs() >= 0.05) & ((x - x.shift(1)).abs() >= 5.0)).tolist()
    want, last = [], None
    for i, t in enumerate(pdf["ts"]):
        if fires[i] and not (i and fires[i - 1]) and (last is None or t - last >= pd.Timedelta("60min")):
            want.append(t.to_pydatetime())
            last = t
    assert got == want and len(want) > 3


def test_result_does_not_depend_on_row_order(spark):
    from wellspark import fixtures as fx

    d = "/root/testdata/sf0.001"
    once = Detection(fx.telemetry(spark, d), fx.annotations(spark, d), fx.SETTINGS).records
    again = Detection(fx.telemetry(spark, d).orderBy(F.rand(1)).repartition(5), fx.annotations(spark, d).repartition(3), fx.SETTINGS).records
    pick = ("well", "start", "reference_start", "reference_notes")
    assert sorted(map(tuple, once.select(*pick).collect())) == sorted(map(tuple, again.select(*pick).collect()))
    assert once.groupBy("well", "reference_start").count().where("count > 1").isEmpty()
    assert len(once.columns) == 36


def test_alignment_settings_reach_the_grid(spark):
    pdf = random_samples(n=60)
    run = Detection(to_spark(spark, pdf), spark.createDataFrame([], "row_id long, well string, cause string, start_ts timestamp_ntz, end_ts timestamp_ntz, notes array<string>"), DetectSettings(align=AlignSettings("1h")))
    assert run.raw_base.where(F.minute("ts") != 0).isEmpty()
    assert run.intervals.isEmpty() and run.baseline.isEmpty() and run.model is None and run.thresholds.isEmpty()
    assert run.records.isEmpty()


def test_cells_with_line_breaks(spark, tmp_path, monkeypatch):
    """Records are those of Python's reader, whole and in blocks of a few bytes."""
    import csv
    import random

    rng = random.Random(4)
    pool = ["", "a", "b c", 'say "so"', "1,2", "line\nbreak", '"', "\n\n", "x" * 30, ",", "é"]
    tables = [[[rng.choice(pool) for _ in range(rng.randint(2, 5))] for _ in range(40)] for _ in range(3)]
    for i, rows in enumerate(tables):
        with open(tmp_path / f"sheet{i}.csv", "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows(rows)
    for size in ("128m", "97b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            found = cells.read_cells(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        for i, rows in enumerate(tables):
            own = sorted((r["row_id"], r["cells"]) for r in found if r["source_id"].endswith(f"sheet{i}.csv"))
            assert [n for n, _ in own] == list(range(len(rows)))
            assert [[c or "" for c in r] for _, r in own] == rows
