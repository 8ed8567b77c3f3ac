"""Registered queries: each operator over the driver tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from queries import sql as S
from wellspark import fixtures as fx
from wellspark.functions import scalar as fn
from wellspark.operators import (
    align,
    baseline,
    clean,
    evaluate,
    events,
    features,
    intervals,
    ordering,
    residual,
    summaries,
    thresholds,
)
from wellspark.plans.detection import Detection
from wellspark.plans.reference import ReferenceAnalysis
from wellspark.schema import DAY
from wellspark.sources import annotations as ann_source
from wellspark.sources import payload as payload_source
from wellspark.sources import sinks
from wellspark.sources import telemetry as tele_source
from wellspark.staging import new_path, prepare, stage
from wellspark.streaming.detector import detect_stream
from wellspark.streaming.resample import resample_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_runs: dict[tuple, object] = {}


def query(name: str, final: str | None = None, *deps: str):
    def register(fun: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fun(prepare(spark), sf_dir)

        QUERIES[name] = run
        if final is not None:
            ORACLE[name] = S.build(final, *deps)
        return fun

    return register


def _shared(kind, spark: SparkSession, sf_dir: str):
    """One workflow object per session and data folder; its tables are staged on first use."""
    key = (kind.__name__, spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        _runs[key] = kind(fx.telemetry(spark, sf_dir), fx.annotations(spark, sf_dir), fx.SETTINGS)
    return _runs[key]


def detection(spark: SparkSession, sf_dir: str) -> Detection:
    return _shared(Detection, spark, sf_dir)


def reference(spark: SparkSession, sf_dir: str) -> ReferenceAnalysis:
    return _shared(ReferenceAnalysis, spark, sf_dir)


def forget() -> None:
    """Drop the shared workflow objects, so the next query starts from the source tables."""
    _runs.clear()


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of decimals, negative zero as zero."""
    return df.select(*[(F.round(c, S.digits(c)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- sources -------------------------------------------------------------------------------------


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ragged sheet: each row fills one metric's pair of text columns."""
    columns = []
    for event, metric in fx.METRIC_OF.items():
        own = F.col("event_type") == event
        layout = "dd.MM.yyyy HH:mm:ss.SSSSSS" if metric == "Current" else "yyyy-MM-dd HH:mm:ss.SSSSSS"
        columns.append(F.when(own, F.date_format("ts", layout)).alias(f"timestamp_{metric}"))
        text = F.when(F.col("event_id") % 97 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
        columns.append(F.when(own, text).alias(metric))
    rows = fx.table(spark, sf_dir, "events")
    return rows.select(fx._well().alias("well"), F.col("event_id").alias("row_id"), F.lit("x").alias("timestamp_Orphan"), *columns)


@query(
    "A1_unpivot_telemetry",
    "SELECT well, metric, ts, CASE WHEN row_id % 97 <> 0 THEN value END AS value, row_id FROM tele",
    "tele",
)
def _(spark, d):
    return tele_source.unpivot_telemetry(_wide(spark, d))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON documents of at most 40 rows, in four shapes by document number."""
    doc = fn.floor_div("event_id", 40)
    cell = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp_V"), F.col("value").cast("string").alias("V"))
    rows = fx.table(spark, sf_dir, "events").select(doc.alias("doc"), F.col("event_id").alias("n"), fx._well().alias("sheet"), cell.alias("r"))
    sheets = rows.groupBy("doc", "sheet").agg(F.array_sort(F.collect_list(F.struct("n", "r"))).alias("rs"))
    cells = F.transform("rs", lambda x: x["r"])

    def keyed(c: str):
        return F.map_from_entries(F.transform("rs", lambda x, i: F.struct(i.cast("string").alias("k"), x["r"][c].alias("v"))))

    column = {c: keyed(c) for c in ("timestamp_V", "V")}
    sheets = sheets.select(
        "doc",
        "sheet",
        cells.alias("rows"),
        F.struct(column["timestamp_V"].alias("timestamp_V"), column["V"].alias("V")).alias("columns"),
    )
    shape = F.col("doc") % 4
    by_doc = sheets.groupBy("doc").agg(
        F.collect_list(F.struct(F.col("sheet").alias("name"), F.col("rows").alias("records"))).alias("described"),
        F.map_from_entries(F.collect_list(F.struct("sheet", "rows"))).alias("listed"),
        F.map_from_entries(F.collect_list(F.struct("sheet", "columns"))).alias("turned"),
    )
    text = (
        F.when(shape == 0, F.to_json(F.struct(F.col("described").alias("sheets"))))
        .when(shape == 1, F.to_json("listed"))
        .when(shape == 2, F.to_json("turned"))
        .otherwise(F.to_json("described"))
    )
    return by_doc.select(F.col("doc").alias("payload_id"), F.concat(F.lit('{"data": '), text, F.lit("}")).alias("value"))


@query(
    "A2_json_sheets",
    """SELECT event_id // 40 AS payload_id, 'w' || (user_id % 10) AS sheet,
  row_number() OVER (PARTITION BY event_id // 40, user_id % 10 ORDER BY event_id) - 1 AS row_no,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, round(value, 6) + 0.0 AS v FROM events""",
)
def _(spark, d):
    rows = payload_source.sheets_from_json(_payloads(spark, d), payload_path="data")
    return rounded(
        rows.select(
            "payload_id",
            "sheet",
            F.col("row_no").cast("bigint").alias("row_no"),
            F.col("record")["timestamp_V"].alias("stamp"),
            fn.coerce_num(F.col("record")["V"]).alias("v"),
        )
    )


def _annotation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as annotation sheets, one per source: two leading rows, the header, then the rows.

    Well and cause are written only where they change from a multiple of three events before.
    """
    names = ann_source.AnnotationColumns()
    rows = fx.table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    rows = rows.select(
        (F.col("user_id") % 5).alias("source_id"),
        "event_id",
        F.when(F.col("event_id") % 3 == 0, fx._well()).alias("w"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string"))).alias("c"),
        F.when(F.col("event_id") % 11 != 0, F.date_format("ts", "dd.MM.yyyy HH:mm")).otherwise("?").alias("s"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("e"),
    )
    body = rows.select(
        "source_id",
        (F.col("event_id") + 3).alias("row_id"),
        F.array("w", "c", "s", "e", F.concat(F.lit(" n"), F.col("event_id").cast("string")), F.lit(" ")).alias("cells"),
    )
    head = F.array(*[F.lit(x) for x in (names.well, names.cause, names.start, names.end, None, "Unnamed: 9")])
    first = F.array(F.lit("title"), *[F.lit(None).cast("string")] * 5)
    lead = F.inline(F.array(*[F.struct(F.lit(i).cast("bigint").alias("row_id"), c.alias("cells")) for i, c in enumerate((first, first, head))]))
    return body.unionByName(rows.select("source_id").distinct().select("source_id", lead))


_SHEET_SQL = """SELECT user_id % 5 AS source_id, event_id + 3 AS row_id,
  last_value(CASE WHEN event_id % 3 = 0 THEN 'w' || (user_id % 10) END IGNORE NULLS) OVER w AS well,
  last_value(CASE WHEN event_id % 3 = 0 THEN 'c' || (event_id % 7) END IGNORE NULLS) OVER w AS cause,
  CASE WHEN event_id % 11 <> 0 THEN date_trunc('minute', ts) END AS start_ts, date_trunc('second', ts) AS end_ts, 'n' || event_id AS notes
FROM events WHERE event_type = 'error'
WINDOW w AS (PARTITION BY user_id % 5 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("A3_read_annotations", _SHEET_SQL)
def _(spark, d):
    rows = ann_source.read_annotations(_annotation_cells(spark, d))
    return rows.withColumn("notes", F.concat_ws("|", "notes"))


@query(
    "A4_lenient_types",
    """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 1 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('day', ts) WHEN 2 THEN ts - INTERVAL 3 HOUR ELSE ts END AS ts,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 6) + 0.0 END AS value FROM events""",
)
def _(spark, d):
    n = F.col("event_id") % 5
    text = (
        F.when(n == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(n == 1, F.date_format("ts", "dd.MM.yyyy HH:mm"))
        .when(n == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+03:00")))
        .when(n == 3, F.date_format("ts", "d/M/yyyy"))
        .otherwise("31.31.2024")
    )
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("12,5 bar")).otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    rows = fx.table(spark, d, "events").select("event_id", text.alias("t"), raw.alias("v"))
    return rounded(rows.select("event_id", fn.coerce_ts("t").alias("ts"), fn.coerce_num("v").alias("value")))


@query(
    "A5_conformance_report",
    "SELECT 'wells' AS \"table\", c AS \"column\", c = 'Missing' AS missing, CASE WHEN c = 'Missing' THEN 0 ELSE n END AS checked, bad AS failed FROM ("
    + " UNION ALL ".join(
        f"SELECT 'timestamp_{m}' AS c, count(*) AS n, 0 AS bad FROM tele WHERE metric = '{m}' UNION ALL "
        f"SELECT '{m}', count(*), count(*) FILTER (row_id % 97 = 0) FROM tele WHERE metric = '{m}'"
        for m in S.METRICS
    )
    + " UNION ALL SELECT 'Missing', 0, 0)",
    "tele",
)
def _(spark, d):
    spec = {f"timestamp_{m}": "timestamp" for m in S.METRICS} | {m: "double" for m in S.METRICS} | {"Missing": "double"}
    return tele_source.conformance_report(_wide(spark, d), "wells", spec)


@query(
    "A6_load_detections",
    "SELECT CAST(user_id AS VARCHAR) AS well, ts AS start FROM events WHERE event_type = 'error'",
)
def _(spark, d):
    path = new_path(spark, "detections")
    rows = fx.table(spark, d, "events").select(
        F.col("user_id").alias("well"), F.col("ts").alias("start"), F.when(F.col("event_type") == "error", "anomaly").otherwise("normal").alias("segment_type")
    )
    rows.write.parquet(path)
    return tele_source.load_detections(spark, path).select("well", "start")


@query("A7_raw_aligned", "SELECT well, metric, ts, value FROM clipped", "clipped")
def _(spark, d):
    return align.aligned_samples(fx.telemetry(spark, d))


# --- sinks ---------------------------------------------------------------------------------------

_BASE_SQL = f"SELECT well, ts, {S.r6(*S.BASE)} FROM base"
_CLEAN_SQL = f"SELECT well, ts AS timestamp, {S.r6(*S.BASE)} FROM clean"


@query("B1_timeseries_sink", _CLEAN_SQL, "clean")
def _(spark, d):
    folder = new_path(spark, "report")
    sinks.write_timeseries(detection(spark, d).base, folder)
    return rounded(spark.read.parquet(f"{folder}/timeseries_15min.parquet"))


@query("B2_pressure_fast_sink", "SELECT well, ts AS timestamp, value AS Intake_Pressure FROM clipped WHERE metric = 'Intake_Pressure'", "clipped")
def _(spark, d):
    folder = new_path(spark, "report")
    sinks.write_pressure_fast(detection(spark, d).pressure_fast, folder)
    return spark.read.parquet(f"{folder}/pressure_fast.parquet")


_BASELINE_SQL = f'SELECT metric, bin_index, "count", {S.r6("frequency_center", "median", "mad")} FROM baseline{{}}'


@query("B3_baseline_sink", _BASELINE_SQL.format(""), "baseline")
def _(spark, d):
    folder = new_path(spark, "report")
    sinks.write_baseline(detection(spark, d).baseline, folder)
    return rounded(spark.read.parquet(f"{folder}/frequency_baseline.parquet"))


@query("B4_detections_sink", S.RECORDS, "records")
def _(spark, d):
    folder = new_path(spark, "report")
    sinks.write_detections(detection(spark, d).records, folder)
    return rounded(spark.read.parquet(f"{folder}/anomaly_analysis.parquet"))


@query("B5_detections_json", S.RECORDS, "records")
def _(spark, d):
    folder, records = new_path(spark, "report"), detection(spark, d).records
    sinks.write_detections(records, folder)
    return rounded(spark.read.schema(records.schema).json(f"{folder}/anomaly_analysis.json"))


_LIMITS = ("thr_delta", "thr_slope", "normal_delta", "normal_slope")
_ECHO = ", ".join("('" + f"{section}.{name}={value}".replace("'", "''") + "')" for section, name, value in sinks.settings_rows(fx.SETTINGS))


@query(
    "B6_run_summary",
    " UNION ALL ".join(
        [f"SELECT 'thresholds' AS part, cause_group || '.{c}' AS name, {S.rnd(c, 'number')} FROM thresholds" for c in _LIMITS]
        + [
            """SELECT 'training', coalesce(nullif(cause_group, 'normal'), '-') || '.' || item || '.' || name, coalesce(points, 0)::DOUBLE
FROM train_members LEFT JOIN train_points USING (cause_group)""",
            f"SELECT 'settings', name, NULL FROM (VALUES {_ECHO}) v(name)",
            f"SELECT 'detections', well || ' ' || strftime(start, '%Y-%m-%d %H:%M:%S') || ' ' || reference_notes, {S.rnd('score', 'number')} FROM records",
        ]
    ),
    "thresholds",
    "train_members",
    "train_points",
    "records",
)
def _(spark, d):
    folder, run = new_path(spark, "report"), detection(spark, d)
    training, records = run.training, run.records
    sinks.write_run_summary(run.thresholds, training, records, run.cfg, folder)
    part = {n: spark.read.schema(t.schema).json(f"{folder}/summary/{n}") for n, t in (("thresholds", run.thresholds), ("training", training), ("detections", records))}
    limits = F.inline(F.array(*[F.struct(F.concat("cause_group", F.lit(f".{c}")).alias("name"), F.col(c).alias("number")) for c in _LIMITS]))
    member = F.concat_ws(".", F.coalesce("cause_group", F.lit("-")), "item", "name")
    settings = spark.read.json(f"{folder}/summary/settings")
    found = F.concat_ws(" ", "well", F.date_format("start", "yyyy-MM-dd HH:mm:ss"), "reference_notes")
    rows = [
        part["thresholds"].select(F.lit("thresholds").alias("part"), limits),
        part["training"].select(F.lit("training"), member, F.col("points").cast("double")),
        settings.select(F.lit("settings"), F.concat("section", F.lit("."), "setting", F.lit("="), "value"), F.lit(None).cast("double")),
        part["detections"].select(F.lit("detections"), found, "score"),
    ]
    return rounded(reduce(DataFrame.union, rows))


_SUMMARY_SQL = (
    'SELECT label, "column", count(*) AS "count", '
    + ", ".join(
        S.rnd(e, f'"{n}"')
        for n, e in (
            ("mean", "avg(value)"), ("std", "stddev_pop(value)"), ("min", "min(value)"), ("max", "max(value)"),
            ("p10", "quantile_cont(value, 0.1)"), ("p50", "quantile_cont(value, 0.5)"), ("p90", "quantile_cont(value, 0.9)"),
        )
    )
    + " FROM stats_long GROUP BY ALL"
)


@query("B7_reference_sink", _SUMMARY_SQL, "stats_long")
def _(spark, d):
    folder, run = new_path(spark, "report"), reference(spark, d)
    sinks.write_reference(run.stats, run.summary, folder)
    return rounded(spark.read.json(f"{folder}/events_summary"))


# --- scalar rules --------------------------------------------------------------------------------


@query(
    "C1_valid_samples",
    "SELECT well, metric, ts, value FROM tele WHERE row_id % 13 <> 0 AND row_id % 17 <> 0 AND row_id % 19 <> 0",
    "tele",
)
def _(spark, d):
    n = F.col("row_id")
    broken = F.when(n % 13 == 0, F.lit(None)).when(n % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = fx.telemetry(spark, d).withColumns({"value": broken, "ts": F.when(n % 19 != 0, F.col("ts"))})
    return align.valid_samples(rows).select("well", "metric", "ts", "value")


@query(
    "C2_label_set",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type
  ELSE least(event_type, 'extra') || '|' || greatest(event_type, 'extra') END AS labels FROM events""",
)
def _(spark, d):
    t = F.col("event_type")
    second = F.when(F.col("event_id") % 2 == 1, F.lit("extra "))
    raw = F.array(F.concat(F.lit(" "), t, F.lit(" ")), t, F.lit(""), F.lit(None).cast("string"), second)
    return fx.table(spark, d, "events").select("event_id", F.concat_ws("|", fn.normalize_labels(raw)).alias("labels"))


@query("C3_classify_labels", "SELECT row_id, well, cause, label FROM labelled", "labelled")
def _(spark, d):
    rules = fx.RULES
    rows = fx.annotations(spark, d).withColumn("cause", F.concat(F.lit(" "), F.col("cause")))
    label = fn.classify_label("cause", rules.anomaly, rules.normal)
    return rows.select("row_id", "well", F.trim("cause").alias("cause"), label.alias("label")).where(F.col("label").isNotNull())


@query(
    "C4_collect_notes",
    "SELECT event_id, concat_ws('|', CASE WHEN event_id % 2 = 0 THEN event_type END, CASE WHEN user_id % 3 = 0 THEN props END) AS notes FROM events",
)
def _(spark, d):
    rows = fx.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("  "), F.col("event_type"))).otherwise("  ").alias("Unnamed: 4"),
        F.when(F.col("user_id") % 3 == 0, F.col("props")).alias("Unnamed: 5"),
    )
    notes = fn.notes_list([c for c in rows.columns if c.startswith("Unnamed")])
    return rows.select("event_id", F.concat_ws("|", notes).alias("notes"))


@query(
    "C5_notes_text",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || '; ' || props END AS notes FROM events",
)
def _(spark, d):
    notes = F.when(F.col("event_id") % 3 != 0, F.array("event_type", "props"))
    return fx.table(spark, d, "events").select("event_id", fn.notes_text(notes).alias("notes"))


@query(
    "C6_safe_divide",
    f"SELECT l_orderkey, l_linenumber, {S.rnd('l_extendedprice / nullif(l_discount, 0)', 'ratio')} FROM lineitem",
)
def _(spark, d):
    ratio = fn.safe_divide("l_extendedprice", "l_discount")
    return rounded(fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio")))


@query(
    "C7_direction",
    f"SELECT l_returnflag, {S.direction('delta', 'direction')}, count(*) AS n FROM (SELECT *, CASE WHEN l_linenumber <> 7 THEN round(l_discount * 3 - l_tax * 4, 2) END AS delta FROM lineitem) GROUP BY ALL",
)
def _(spark, d):
    delta = F.when(F.col("l_linenumber") != 7, F.round(F.col("l_discount") * 3 - F.col("l_tax") * 4, 2))
    rows = fx.table(spark, d, "lineitem").select("l_returnflag", fn.direction(delta).alias("direction"))
    return rows.groupBy("l_returnflag", "direction").agg(F.count("*").alias("n"))


@query(
    "C8_overlaps",
    """SELECT o_orderkey, count(*) AS n, count(*) FILTER (NOT (l_shipdate + INTERVAL 10 DAY < o_orderdate OR l_shipdate > o_orderdate + INTERVAL 30 DAY)) AS overlapping
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def _(spark, d):
    rows = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ten, thirty = F.expr("interval 10 days"), F.expr("interval 30 days")
    hit = fn.overlaps("l_shipdate", F.col("l_shipdate") + ten, "o_orderdate", F.col("o_orderdate") + thirty)
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.count_if(hit).alias("overlapping"))


@query("C9_cause_family", "SELECT row_id, contains(cause, 'inflow') AS inflow, contains(cause, 'leak') AS leak FROM ann", "ann")
def _(spark, d):
    return fx.annotations(spark, d).select(
        "row_id", fn.is_inflow("cause", fx.RULES).alias("inflow"), fn.is_leak("cause", fx.RULES).alias("leak")
    )


@query("C10_effective_thresholds", f"SELECT well, cause, inflow, leak, {S.r6('thr_delta', 'thr_slope')} FROM rules", "rules")
def _(spark, d):
    return rounded(detection(spark, d).rules.select("well", "cause", "inflow", "leak", "thr_delta", "thr_slope"))


@query("C11_pinned_group", f"SELECT cause_group, {S.r6('thr_delta', 'thr_slope')} FROM thresholds WHERE cause_group = 'inflow'", "thresholds")
def _(spark, d):
    return rounded(detection(spark, d).thresholds.where(F.col("cause_group") == "inflow").select("cause_group", "thr_delta", "thr_slope"))


@query("C12_base_signal", "SELECT well, ts, base_flag FROM signals", "signals")
def _(spark, d):
    run = detection(spark, d)
    rows = run.features.join(run.rules, "well")
    return rows.select("well", "ts", fn.base_signal("pressure_delta", "pressure_slope", "thr_delta", "thr_slope").alias("base_flag"))


@query(
    "C13_feature_limits",
    "SELECT feature, count(*) AS n, count(DISTINCT well) AS wells FROM pool GROUP BY feature",
    "pool",
)
def _(spark, d):
    run = detection(spark, d)
    pool = thresholds.pool_features(run.features, run.train_normals)
    return pool.groupBy("feature").agg(F.sum("weight").alias("n"), F.countDistinct("well").alias("wells"))


@query(
    "C14_early_gate",
    """SELECT s.well, s.ts, r.interval_id, CASE
    WHEN inflow THEN flag AND abs(pressure_slope) >= 3.0 * thr_slope AND abs(pressure_delta) >= 3.0 * thr_delta AND r.start_ts - s.ts <= INTERVAL 12 HOUR
    WHEN leak THEN flag AND (abs(pressure_slope) >= 0.6 * thr_slope OR abs(pressure_delta) >= greatest(0.5 * thr_delta, 0.01)) ELSE true END AS allowed
FROM (SELECT *, residual_flag OR ewma_flag OR spike_flag AS flag FROM signals WHERE pressure_delta IS NOT NULL AND pressure_slope IS NOT NULL) s
JOIN refs r ON r.well = s.well AND s.ts < r.start_ts AND s.ts >= r.start_ts - INTERVAL 18 HOUR""",
    "signals",
    "refs",
)
def _(spark, d):
    run = detection(spark, d)
    flagged = F.col("residual_flag") | F.col("ewma_flag") | F.col("spike_flag")
    points = run.scored.withColumn("any_flag", flagged).where("pressure_delta is not null and pressure_slope is not null")
    spans = run.references.select("interval_id", "well", "start_ts", (F.col("start_ts") - F.expr("interval 1 microsecond")).alias("end_ts"))
    pairs = intervals.points_in_intervals(points, spans, start=F.col("start_ts") - F.expr("interval 18 hours"))
    lead = fn.micros("start_ts") - fn.micros("ts")
    gate = fn.early_gate(lead, "pressure_delta", "pressure_slope", "any_flag", "thr_delta", "thr_slope", "inflow", "leak")
    return pairs.join(run.rules, "well").select("well", "ts", "interval_id", gate.alias("allowed"))


@query("C15_score", f"SELECT well, ts, {S.rnd('pressure_delta * pressure_slope', 'score')} FROM features", "features")
def _(spark, d):
    return rounded(detection(spark, d).features.select("well", "ts", fn.score("pressure_delta", "pressure_slope").alias("score")))


@query("C16_split_holdout", "SELECT well, interval_id, label FROM intervals WHERE well NOT IN ('w3', 'w7')", "intervals")
def _(spark, d):
    return intervals.split_holdout(detection(spark, d).intervals, fx.SETTINGS.holdout).select("well", "interval_id", "label")


@query("C17_cause_groups", "SELECT interval_id, cause, cause_group FROM grouped", "grouped")
def _(spark, d):
    return intervals.map_groups(detection(spark, d).anomalies, fx.RULES).select("interval_id", "cause", "cause_group")


@query(
    "C18_include_normal",
    """SELECT cause_group, min(row_id) AS first_row, arg_max(include, place) AS include_normal FROM grouped
JOIN (VALUES ('tubing_leak', 0, false), ('inflow_drop', 1, false), ('inflow_rise', 2, true)) p(cause, place, include) USING (cause) GROUP BY cause_group""",
    "grouped",
)
def _(spark, d):
    included = {"inflow_rise": True}
    profiles = tuple(replace(p, include_normal=included.get(p.name, False)) for p in fx.RULES.profiles)
    return thresholds.group_includes_normal(detection(spark, d).intervals, replace(fx.RULES, profiles=profiles))


@query(
    "C19_minutes_between",
    "SELECT l_orderkey, l_linenumber, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 6e7 AS minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _(spark, d):
    rows = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", fn.minutes_between("l_shipdate", "o_orderdate").alias("minutes"))


@query(
    "C20_frequency_bin",
    "SELECT event_id, CAST(floor(value / 20.0) AS BIGINT) AS bin_index, CAST((floor(value / 20.0) + 0.5) * 20 AS DOUBLE) AS center FROM events",
)
def _(spark, d):
    rows = fx.table(spark, d, "events").withColumn("bin_index", fn.freq_bin("value", 20.0))
    return rows.select("event_id", "bin_index", fn.bin_center("bin_index", 20.0).alias("center"))


@query("C21_canonical_well", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS well FROM events")
def _(spark, d):
    n, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    raw = F.when(n == 0, F.concat(u, F.lit(".0"))).when(n == 1, F.concat(F.lit(" "), u)).when(n == 2, u).otherwise(" ")
    return fx.table(spark, d, "events").select("event_id", fn.canon_well(raw).alias("well"))


# --- joins ---------------------------------------------------------------------------------------


@query("J1_clip_intervals", "SELECT interval_id, well, label, cause, start_ts, end_ts, notes FROM intervals", "intervals")
def _(spark, d):
    run = detection(spark, d)
    rows = intervals.reference_intervals(run.annotations, run.base, fx.RULES)
    return rows.select("interval_id", "well", "label", "cause", "start_ts", "end_ts", fn.notes_text("notes").alias("notes"))


@query(
    "J2_points_in_intervals",
    "SELECT t.row_id AS sample, t.metric, i.interval_id FROM tele t JOIN intervals i ON i.well = t.well AND t.ts BETWEEN i.start_ts AND i.end_ts",
    "tele",
    "intervals",
)
def _(spark, d):
    points = fx.telemetry(spark, d).withColumnRenamed("row_id", "sample")
    spans = detection(spark, d).intervals.select("well", "interval_id", "start_ts", "end_ts")
    return intervals.points_in_intervals(points, spans, width=DAY // 6).select("sample", "metric", "interval_id")


@query("J3_baseline_lookup", f"SELECT well, ts, {S.r6(*[f'{n}_expected' for n in S.NAMES])} FROM applied", "applied")
def _(spark, d):
    run = detection(spark, d)
    profile = stage(features.well_profile(run.base, run.baseline, run.cfg.features, run.cfg.baseline), "profile")
    rows = features.apply_baseline(run.base, run.baseline, profile, run.cfg.baseline.bin_width)
    return rounded(rows.select("well", "ts", *[f"{n}_expected" for n in S.NAMES]))


@query("J4_pivot_metrics", _BASE_SQL, "base")
def _(spark, d):
    return rounded(detection(spark, d).raw_base.drop("pos"))


@query(
    "J5_mark_normal",
    "SELECT t.row_id, EXISTS (SELECT 1 FROM normals n WHERE n.well = t.well AND t.ts BETWEEN n.start_ts AND n.end_ts) AS in_normal FROM tele t",
    "tele",
    "normals",
)
def _(spark, d):
    return intervals.mark_normal(fx.telemetry(spark, d), detection(spark, d).normals).select("row_id", "in_normal")


@query(
    "J6_first_containing",
    "SELECT t.row_id AS sample, arg_min(a.interval_id, a.row_id) AS interval_id FROM tele t JOIN anomalies a ON a.well = t.well AND t.ts BETWEEN a.start_ts AND a.end_ts GROUP BY t.row_id",
    "tele",
    "anomalies",
)
def _(spark, d):
    points = fx.telemetry(spark, d).select("well", "ts", F.col("row_id").alias("sample"))
    found = intervals.containing(points, detection(spark, d).anomalies, ["well", "ts", "sample"])
    return found.select("sample", "interval_id")


@query("J7_nearest_unassigned", "SELECT * FROM matches WHERE NOT supplemental", "matches")
def _(spark, d):
    return detection(spark, d).matches.where(~F.col("supplemental"))


@query(
    "J8_asof_nearest",
    """SELECT a.row_id, arg_min(c.ts, (abs(epoch_us(c.ts) - epoch_us(a.start_ts)) * 2 - CASE WHEN c.ts >= a.start_ts THEN 1 ELSE 0 END)) AS near_ts
FROM ann a JOIN clean c ON c.well = a.well GROUP BY a.row_id""",
    "ann",
    "clean",
)
def _(spark, d):
    left = fx.annotations(spark, d).select("well", "row_id", F.col("start_ts").alias("ts"))
    return intervals.asof_nearest(left, detection(spark, d).base, "row_id").select("row_id", "near_ts")


@query(
    "J9_uncovered_references",
    "SELECT interval_id, well FROM anomalies a WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.well = a.well AND k.ts BETWEEN a.start_ts AND a.end_ts)",
    "anomalies",
    "kept",
)
def _(spark, d):
    run = detection(spark, d)
    return intervals.uncovered(run.anomalies, run.events).select("interval_id", "well")


@query(
    "J10_resolve_thresholds",
    f"SELECT well, cause, cause_group, {S.r6('thr_delta', 'thr_slope', 'normal_delta', 'normal_slope')} FROM well_thresholds",
    "well_thresholds",
)
def _(spark, d):
    run = detection(spark, d)
    return rounded(thresholds.resolve_thresholds(run.base, run.intervals, run.thresholds, fx.RULES))


@query("J11_cause_references", "SELECT interval_id, well, cause FROM refs", "refs")
def _(spark, d):
    return detection(spark, d).references.select("interval_id", "well", "cause")


@query(
    "J12_windows_by_well",
    "SELECT well, label, row_number() OVER (PARTITION BY well, label ORDER BY row_id) AS nth, start_ts, end_ts FROM intervals",
    "intervals",
)
def _(spark, d):
    return intervals.windows_by_well(detection(spark, d).intervals)


# --- aggregations --------------------------------------------------------------------------------


@query(
    "D1_dedup_last",
    """SELECT 'w' || (l_suppkey % 10) AS well, l_returnflag AS metric, l_shipdate AS ts,
  arg_max(l_quantity, l_orderkey * 1000000 + l_linenumber * 1000 + l_quantity) AS value FROM lineitem GROUP BY ALL""",
)
def _(spark, d):
    return align.dedup_last(fx.lineitem_telemetry(spark, d))


@query("D2_common_range", "SELECT well, range_start, range_end FROM ranges", "ranges")
def _(spark, d):
    return align.common_range(align.metric_bounds(align.valid_samples(fx.telemetry(spark, d))))


def _resampled(spark: SparkSession, sf_dir: str, aggregation: str = "mean") -> DataFrame:
    rows = align.valid_samples(fx.telemetry(spark, sf_dir))
    ranges = stage(align.common_range(align.metric_bounds(rows)), "ranges")
    cfg = align.AlignSettings("6h", aggregation)
    return align.in_range(align.resample(align.clip_common_range(rows, ranges), cfg))


_IN_RANGE = "FROM bins WHERE bin BETWEEN range_start AND range_end"


@query("D3_resample_mean", f"SELECT well, metric, bin AS ts, {S.r6('value')} {_IN_RANGE}", "bins")
def _(spark, d):
    return rounded(_resampled(spark, d).select("well", "metric", "ts", "value"))


@query(
    "D3_resample_median",
    f"""SELECT well, metric, ts, {S.r6('value')} FROM (SELECT well, metric, range_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts,
  quantile_cont(value, 0.5) AS value FROM (SELECT well, metric, range_start, ts AS ts, value FROM clipped) GROUP BY well, metric, range_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) WHERE ts >= range_start""",
    "clipped",
)
def _(spark, d):
    return rounded(_resampled(spark, d, "median").select("well", "metric", "ts", "value"))


@query("D4_bin_extrema", f"SELECT well, metric, bin AS ts, min_value, max_value {_IN_RANGE}", "bins")
def _(spark, d):
    return _resampled(spark, d).select("well", "metric", "ts", "min_value", "max_value")


@query("D5_frequency_baseline", _BASELINE_SQL.format(""), "baseline")
def _(spark, d):
    run = detection(spark, d)
    return rounded(baseline.build_baseline(run.base, run.train_normals, run.cfg.baseline))


@query(
    "D6_scale_profile",
    "SELECT f.well, f.metric, round(f.fallback, 8) + 0.0 AS fallback, round(coalesce(g.found, f.fallback), 8) + 0.0 AS fill FROM known f LEFT JOIN fills g USING (well, metric)",
    "known",
    "fills",
)
def _(spark, d):
    run = detection(spark, d)
    return rounded(baseline.scale_profile(run.base, run.baseline, run.cfg.baseline.bin_width))


@query("D7_window_params", "SELECT well, metric, w, s, mp FROM windows", "windows")
def _(spark, d):
    rows = features.window_params(detection(spark, d).base, fx.SETTINGS.features)
    return rows.select("well", "metric", *[F.col(c).cast("bigint").alias(c) for c in ("w", "s", "mp")])


@query("D7_clean_params", "SELECT well, half, fill FROM params", "params")
def _(spark, d):
    rows = clean.clean_params(detection(spark, d).raw_base, fx.SETTINGS.clean)
    return rows.select("well", *[F.col(c).cast("bigint").alias(c) for c in ("half", "fill")])


@query("D8_tail_thresholds", f"SELECT feature, {S.r6('tight', 'loose')} FROM cuts", "cuts")
def _(spark, d):
    run = detection(spark, d)
    pool = thresholds.pool_features(run.features, run.train_normals)
    return rounded(thresholds.tail_thresholds(pool, {"tight": 0.01, "loose": 0.05}))


@query(
    "D9_residual_model",
    "SELECT " + ", ".join(S.rnd(e, n) for e, n in (("mx", "mx"), ("my", "my"), ("mz", "mz"), ("pxx", "pxx"), ("pxy", "pxy"), ("pxz", "pxz"), ("pyy", "pyy"), ("pyz", "pyz"), ("pzz", "pzz"), ("threshold", "threshold"))) + " FROM model, model_cut WHERE mx IS NOT NULL",
    "model",
    "model_cut",
)
def _(spark, d):
    run = detection(spark, d)
    fitted = residual.fit_residual_model(run.features, run.train_normals, run.cfg.residual)
    axes = "xyz"
    at = [F.get("location", i).alias(f"m{axes[i]}") for i in range(3)]
    form = [F.get(F.get("precision", i), j).alias(f"p{axes[i]}{axes[j]}") for i in range(3) for j in range(i, 3)]
    return rounded(residual.model_frame(spark, fitted).select(*at, *form, "threshold"))


@query(
    "D10_pool_features",
    "SELECT well, ts, feature, round(value, 6) + 0.0 AS value, count(*) AS weight FROM pool GROUP BY well, ts, feature, value",
    "pool",
)
def _(spark, d):
    run = detection(spark, d)
    pool = thresholds.pool_features(run.features, run.train_normals)
    return rounded(pool.select("well", "ts", "feature", "value", F.col("weight").cast("bigint").alias("weight")))


@query("D11_well_causes", "SELECT well, cause FROM causes", "causes")
def _(spark, d):
    return intervals.well_causes(detection(spark, d).intervals)


_STATS_SQL = (
    f'SELECT well, label, start, "end", {S.r6(*S.STAT_DOUBLES)}, notes, '
    + ", ".join(S.direction(f"{n}_delta_median", f"{n}_direction") for n in S.NAMES)
    + " FROM interval_stats"
)


@query("D12_interval_stats", _STATS_SQL, "interval_stats")
def _(spark, d):
    run = reference(spark, d)
    return rounded(summaries.interval_stats(run.features, run.intervals))


@query("D13_label_summary", _SUMMARY_SQL, "stats_long")
def _(spark, d):
    return rounded(reference(spark, d).summary)


_CLEANED = " UNION ALL ".join(
    f"SELECT well, '{m}' AS metric, count(*) FILTER ({m}_outlier) AS removed_outliers, count(*) FILTER ({m}_kept IS NULL AND {m} IS NOT NULL) AS ffill_values FROM flagged GROUP BY well"
    for m in S.METRICS
)


@query("D14_cleaning_summary", f"SELECT * FROM ({_CLEANED}) WHERE removed_outliers > 0 OR ffill_values > 0", "flagged")
def _(spark, d):
    return clean.cleaning_summary(detection(spark, d).flagged)


@query(
    "D14_cleaning_totals",
    f"SELECT well, CAST(sum(removed_outliers) AS BIGINT) AS removed, CAST(sum(ffill_values) AS BIGINT) AS ffilled FROM ({_CLEANED}) GROUP BY well",
    "flagged",
)
def _(spark, d):
    return clean.cleaning_totals(clean.cleaning_summary(detection(spark, d).flagged))


@query(
    "D15_training_summary",
    "SELECT nullif(cause_group, 'normal') AS cause_group, item, name, coalesce(points, 0) AS points FROM train_members LEFT JOIN train_points USING (cause_group)",
    "train_members",
    "train_points",
)
def _(spark, d):
    return detection(spark, d).training


@query("D16_quality", f"SELECT reference_count, detections, missed, {S.r6('recall', 'mean_delay_minutes')}, {S.rnd('\"precision\"', '\"precision\"')} FROM quality", "quality")
def _(spark, d):
    return rounded(detection(spark, d).quality)


# --- ordered operators ---------------------------------------------------------------------------

_FLAGGED_SQL = f"SELECT well, ts, {S.r6(*S.BASE)}, {', '.join(f'{m}_outlier' for m in S.METRICS)} FROM flagged"


@query("E1_hampel", _FLAGGED_SQL, "flagged")
def _(spark, d):
    run = detection(spark, d)
    rows = clean.clean(run.raw_base, run.cfg.clean)
    return rounded(rows.drop("pos", *[f"{m}_filled" for m in S.METRICS]))


@query(
    "E2_bounded_fill",
    f"""SELECT well, ts, {", ".join(f"round(last_value({m} IGNORE NULLS) OVER (PARTITION BY well ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) + 0.0 AS {m}" for m in S.METRICS)} FROM base""",
    "base",
)
def _(spark, d):
    rows = ordering.with_halo(detection(spark, d).raw_base, back=2)
    order = Window.partitionBy("well", "_block").orderBy("pos")
    filled = rows.withColumns({f"_{m}": clean.ffill_limit(m, order, 2) for m in S.METRICS})
    return rounded(ordering.own_rows(filled).select("well", "ts", *[F.col(f"_{m}").alias(m) for m in S.METRICS]))


@query("E3_fill_down", _SHEET_SQL)
def _(spark, d):
    parsed = ann_source.parse_annotations(_annotation_cells(spark, d))
    return intervals.ffill_annotations(parsed).withColumn("notes", F.concat_ws("|", "notes"))


_ROLL = "OVER (PARTITION BY well ORDER BY ts ROWS BETWEEN {} PRECEDING AND {})"


@query(
    "E4_rolling_mean",
    "SELECT well, ts, round(CASE WHEN count(pressure_residual) {0} >= 2 THEN avg(pressure_residual) {0} END, 6) + 0.0 AS mean FROM features".format(_ROLL.format(2, "CURRENT ROW")),
    "features",
)
def _(spark, d):
    return _rolled(spark, d, "mean", lambda order: features.rolling_mean("pressure_residual", order, 3, 2))


@query(
    "E5_lagged_rolling_mean",
    "SELECT well, ts, round(CASE WHEN count(pressure_residual) {0} >= 2 THEN avg(pressure_residual) {0} END, 6) + 0.0 AS mean FROM features".format(_ROLL.format(4, "2 PRECEDING")),
    "features",
)
def _(spark, d):
    return _rolled(spark, d, "mean", lambda order: features.rolling_mean("pressure_residual", order, 3, 2, shift=2))


def _rolled(spark: SparkSession, sf_dir: str, name: str, column) -> DataFrame:
    rows = ordering.with_halo(detection(spark, sf_dir).features, back=8)
    order = Window.partitionBy("well", "_block").orderBy("pos")
    return rounded(ordering.own_rows(rows.withColumn(name, column(order))).select("well", "ts", name))


@query("E6_interpolate_time", f"SELECT well, ts, {S.r6(*[f'{n}_before' for n in S.NAMES])} FROM filled", "filled")
def _(spark, d):
    run = detection(spark, d)
    profile = stage(features.well_profile(run.base, run.baseline, run.cfg.features, run.cfg.baseline), "profile")
    rows = features.rolling_features(features.apply_baseline(run.base, run.baseline, profile, 20.0))
    return rounded(rows.select("well", "ts", *[F.col(f"_{n}_before").alias(f"{n}_before") for n in S.NAMES]))


@query("E7_lag_difference", f"SELECT well, ts, {S.rnd('pressure - lag(pressure, 3) OVER (PARTITION BY well ORDER BY ts)', 'slope')} FROM features", "features")
def _(spark, d):
    return _rolled(spark, d, "slope", lambda order: features.lag_difference("pressure", order, 3))


@query("E8_ewma", f"SELECT well, metric, ts, {S.r6('value', 'ewma')} FROM averages", "averages")
def _(spark, d):
    z = baseline.unpivot(detection(spark, d).features, ["well", "ts", "pos"], [f"{n}_z" for n in S.NAMES])
    return rounded(residual.ewma(z, 0.2).select("well", "metric", "ts", "value", "ewma"))


@query("E9_rising_edges", "SELECT well, ts FROM edges", "edges")
def _(spark, d):
    return events.rising_edges(detection(spark, d).scored.where("signal").select("well", "ts", "pos")).select("well", "ts")


@query("E10_suppress_gap", "SELECT well, ts FROM kept", "kept")
def _(spark, d):
    edges = events.rising_edges(detection(spark, d).scored.where("signal").select("well", "ts", "pos"))
    return events.suppress_gap(edges, 1440)


# --- features, model, thresholds -----------------------------------------------------------------


@query("F1_feature_frame", f"SELECT well, ts, {S.r6(*S.FEATURES)} FROM features", "features")
def _(spark, d):
    run = detection(spark, d)
    return rounded(features.feature_frame(run.base, run.baseline, run.cfg.features, run.cfg.baseline).drop("pos"))


_APPLIED = [f"{n}_{c}" for n in S.NAMES for c in ("expected", "residual", "scale")]


@query("F2_apply_baseline", f"SELECT well, ts, {S.r6(*_APPLIED)} FROM applied", "applied")
def _(spark, d):
    run = detection(spark, d)
    profile = stage(features.well_profile(run.base, run.baseline, run.cfg.features, run.cfg.baseline), "profile")
    return rounded(features.apply_baseline(run.base, run.baseline, profile, 20.0).select("well", "ts", *_APPLIED))


@query("H1_t2_score", f"SELECT well, ts, {S.r6('t2_stat')}, t2_flag FROM signals", "signals")
def _(spark, d):
    return rounded(detection(spark, d).scored.select("well", "ts", "t2_stat", "t2_flag"))


@query(
    "H2_group_thresholds",
    f"SELECT cause_group, first_row, {S.r6('thr_delta', 'thr_slope', 'normal_delta', 'normal_slope')} FROM thresholds",
    "thresholds",
)
def _(spark, d):
    run = detection(spark, d)
    return rounded(thresholds.group_thresholds(run.features, run.intervals, run.train_normals, run.cfg))


@query("H3_ewma_flag", "SELECT well, ts, ewma_flag FROM signals", "signals")
def _(spark, d):
    return detection(spark, d).scored.select("well", "ts", "ewma_flag")


@query("H4_spike_flag", "SELECT well, ts, spike_flag FROM signals", "signals")
def _(spark, d):
    return detection(spark, d).scored.select("well", "ts", "spike_flag")


@query("H5_residual_signal", "SELECT well, ts, residual_flag FROM signals", "signals")
def _(spark, d):
    return detection(spark, d).scored.select("well", "ts", "residual_flag")


# --- events and evaluation -----------------------------------------------------------------------


@query("G1_combined_signal", "SELECT well, ts, base_flag, residual_flag, signal FROM signals", "signals")
def _(spark, d):
    run = detection(spark, d)
    rows = events.score_points(run.features, run.rules, run.model, run.normals, run.cfg)
    return rows.select("well", "ts", "base_flag", "residual_flag", "signal")


@query("G2_event_starts", "SELECT well, ts FROM kept", "kept")
def _(spark, d):
    return events.event_starts(detection(spark, d).scored, 1440)


_SNAPSHOT = (*S.DELTAS, "t2_stat", *S.BASE)


@query(
    "G3_event_snapshot",
    f"""SELECT well, ts, {S.r6(*_SNAPSHOT)}, ewma_flag, spike_flag, residual_flag FROM kept
JOIN (SELECT well, ts, {", ".join(S.DELTAS)}, t2_stat, ewma_flag, spike_flag, residual_flag FROM signals) USING (well, ts)
JOIN clean USING (well, ts) WHERE pressure_delta IS NOT NULL AND pressure_slope IS NOT NULL""",
    "kept",
    "signals",
    "clean",
)
def _(spark, d):
    run = detection(spark, d)
    rows = events.event_snapshot(run.events, run.scored, run.base)
    return rounded(rows.select("well", "ts", *_SNAPSHOT, "ewma_flag", "spike_flag", "residual_flag"))


@query("G4_reference_matching", "SELECT * FROM matches", "matches")
def _(spark, d):
    run = detection(spark, d)
    return events.match_references(run.events, run.references, run.scored, run.rules, run.cfg)


@query("G5_supplemental_events", "SELECT * FROM matches WHERE supplemental", "matches")
def _(spark, d):
    return detection(spark, d).matches.where("supplemental")


@query("G6_detection_records", S.RECORDS, "records")
def _(spark, d):
    return rounded(detection(spark, d).records)


_TRIGGERS = f"well, interval_start, interval_end, detection_start, evaluated_points, {S.r6('delay_minutes', *S.DELTAS)}"


@query("G7_first_triggers", f"SELECT {_TRIGGERS} FROM triggers", "triggers")
def _(spark, d):
    return _flat(detection(spark, d).triggers())


def _flat(rows: DataFrame) -> DataFrame:
    inner = [F.col(f"triggers.{c}").alias(c) for c in S.DELTAS]
    kept = ("well", "interval_start", "interval_end", "detection_start", "evaluated_points", "delay_minutes")
    return rounded(rows.select(*kept, *inner))


@query("G8_stepwise_run", f"SELECT {_TRIGGERS} FROM triggers WHERE well IN ('w3', 'w7')", "triggers")
def _(spark, d):
    run = detection(spark, d)
    return _flat(run.triggers(run.cfg.holdout))


@query(
    "G9_calibration_values",
    f"""SELECT cause_group, t.well, interval_start, {S.r6('pressure_delta', 'pressure_slope')} FROM triggers t JOIN grouped g USING (interval_id)
WHERE t.well NOT IN ('w3', 'w7') AND pressure_delta IS NOT NULL AND pressure_slope IS NOT NULL""",
    "triggers",
    "grouped",
)
def _(spark, d):
    return rounded(detection(spark, d).calibration)


@query("G10_detect", S.RECORDS, "records")
def _(spark, d):
    run = Detection(fx.telemetry(spark, d), fx.annotations(spark, d), fx.SETTINGS)
    return rounded(run.records.orderBy("start", "well", "segment_type"))


@query("G11_reference_analysis", _STATS_SQL, "interval_stats")
def _(spark, d):
    run = ReferenceAnalysis(fx.telemetry(spark, d), fx.annotations(spark, d), fx.SETTINGS)
    return rounded(run.stats)


@query(
    "G12_holdout_report",
    """SELECT well, interval_start, detection_start, evaluated_points, CASE WHEN detection_start IS NULL THEN '—' ELSE
  concat_ws(', ', format('ΔP={:.3f}', pressure_delta), format('slope={:.3f}', pressure_slope), format('ΔI={:.3f}', current_delta), format('ΔT={:.3f}', temperature_delta), 'lag=0.0 мин') END AS description
FROM triggers WHERE well IN ('w3', 'w7')""",
    "triggers",
)
def _(spark, d):
    rows = detection(spark, d).holdout_report()
    return rows.select("well", "interval_start", "detection_start", "evaluated_points", "description")


# --- order and sets ------------------------------------------------------------------------------


@query("K1_sorted_intervals", "SELECT well, start_ts, end_ts, label FROM intervals ORDER BY well, start_ts", "intervals")
def _(spark, d):
    return detection(spark, d).intervals.select("well", "start_ts", "end_ts", "label").orderBy("well", "start_ts")


@query("K2_first_by_order", "SELECT well, metric, arg_min(value, row_id) AS value FROM tele GROUP BY well, metric", "tele")
def _(spark, d):
    return fx.telemetry(spark, d).groupBy("well", "metric").agg(F.min_by("value", "row_id").alias("value"))


@query("K3_union_parts", "SELECT well, ts, 'edge' AS part FROM edges UNION ALL SELECT well, ts, 'event' FROM kept", "edges", "kept")
def _(spark, d):
    run = detection(spark, d)
    edges = events.rising_edges(run.scored.where("signal").select("well", "ts", "pos")).select("well", "ts", F.lit("edge").alias("part"))
    return edges.unionByName(run.events.select("well", "ts", F.lit("event").alias("part")))


@query("K4_common_wells", "SELECT well FROM tele INTERSECT SELECT well FROM ann", "tele", "ann")
def _(spark, d):
    return fx.telemetry(spark, d).select("well").intersect(fx.annotations(spark, d).select("well"))


# --- streams -------------------------------------------------------------------------------------


def _drain(rows: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Runs a stream over all available input into a table and reads it back."""
    path = new_path(spark, name)
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


@query(
    "T1_stream_resample",
    f"""SELECT well, metric, bin AS ts, {S.r6('value', 'min_value', 'max_value')} FROM (
  SELECT well, metric, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bin, avg(value) AS value, min(value) AS min_value, max(value) AS max_value
  FROM tele GROUP BY ALL) WHERE bin + INTERVAL 6 HOUR <= (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts), TIMESTAMP '1970-01-01') FROM tele) - INTERVAL 1 HOUR""",
    "tele",
)
def _(spark, d):
    path = new_path(spark, "live")
    fx.telemetry(spark, d).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return rounded(_drain(resample_stream(stream, "6 hours", "1 hour"), spark, "stream-bins"))


@query("T2_stream_detector", f"SELECT well, ts, 'event' AS kind, {S.r6('pressure_delta', 'pressure_slope')} FROM live_kept JOIN live USING (well, ts)", "live_kept", "live")
def _(spark, d):
    run = detection(spark, d)
    path = new_path(spark, "live-grid")
    run.base.select("well", "ts", "Intake_Pressure", "Frequency").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    sizes = features.window_params(run.base, run.cfg.features, ("Intake_Pressure",)).drop("metric")
    limits = stage(run.rules.join(sizes, "well"), "live-rules")
    found = detect_stream(stream, run.baseline, limits, run.cfg.baseline.bin_width, run.cfg.gap_minutes, delay_minutes=720)
    return rounded(_drain(found, spark, "stream-events"))


__all__ = ["DAY", "ORACLE", "QUERIES", "detection", "forget", "reference"]
