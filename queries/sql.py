"""Independent SQL for the registered queries, built from shared common table expressions.

Every statement reads the driver tables directly and repeats none of the Spark code:
range joins are plain ``BETWEEN`` joins, quantiles are ``quantile_cont``, ordered
folds are recursive or list expressions.
"""

from __future__ import annotations

METRICS = ("Intake_Pressure", "Current", "Motor_Temperature", "Frequency")
MODELLED = {"Intake_Pressure": "pressure", "Current": "current", "Motor_Temperature": "temperature"}
NAMES = tuple(MODELLED.values())
BASE = (*METRICS, "Intake_Pressure_min", "Intake_Pressure_max")
FEATURES = (
    "pressure_delta", "pressure_slope", "current_delta", "temperature_delta",
    *[f"{n}{s}" for n in NAMES for s in ("", "_expected", "_residual", "_scale", "_z")], "frequency",
)
DELTAS = ("pressure_delta", "pressure_slope", "current_delta", "temperature_delta")
LIMITS = {"pressure_delta": 10.0, "pressure_slope": 20.0, "current_delta": 10.0, "temperature_delta": 10.0}

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTE[name] = (deps, sql)


def build(final: str, *deps: str) -> str:
    """The final statement behind the expressions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for d in CTE[name][0]:
                visit(d)
            ordered.append(name)

    for d in deps:
        visit(d)
    parts = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in ordered)
    return f"WITH RECURSIVE {parts}\n{final}" if ordered else final


def digits(column: str) -> int:
    """Decimals a column is compared at; products and means of two-decimal inputs would tie at six."""
    return 8 if column.endswith(("_scale", "mad", "fallback", "fill", "_before")) else 6


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, {digits(c)}) + 0.0 AS {c}" for c in columns)


def rnd(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


cte(
    "tele",
    """SELECT 'w' || (user_id % 10) AS well,
  CASE event_type WHEN 'view' THEN 'Intake_Pressure' WHEN 'click' THEN 'Current'
    WHEN 'purchase' THEN 'Motor_Temperature' WHEN 'signup' THEN 'Frequency' END AS metric,
  ts, value, event_id AS row_id
FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup')""",
)
cte("bounds", "SELECT well, metric, min(ts) AS first_ts, max(ts) AS last_ts FROM tele GROUP BY ALL", "tele")
cte(
    "ranges",
    """SELECT well, max(first_ts) AS range_start, min(last_ts) AS range_end FROM bounds
GROUP BY well HAVING max(first_ts) < min(last_ts)""",
    "bounds",
)
cte(
    "clipped",
    """SELECT well, metric, ts, arg_max(value, row_id) AS value, range_start, range_end
FROM tele JOIN ranges USING (well) WHERE ts BETWEEN range_start AND range_end
GROUP BY well, metric, ts, range_start, range_end""",
    "tele",
    "ranges",
)
cte(
    "bins",
    """SELECT well, metric, range_start, range_end, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bin,
  avg(value) AS value, min(value) AS min_value, max(value) AS max_value
FROM clipped GROUP BY ALL""",
    "clipped",
)
cte(
    "dense",
    """SELECT well, range_start, range_end, unnest(generate_series(min(bin), max(bin), INTERVAL 6 HOUR)) AS bin
FROM bins WHERE metric = 'Intake_Pressure' GROUP BY well, range_start, range_end""",
    "bins",
)
cte(
    "base",
    f"""SELECT *, row_number() OVER (PARTITION BY well ORDER BY ts) AS pos FROM (
  SELECT well, bin AS ts,
    {", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in METRICS)},
    max(min_value) FILTER (metric = 'Intake_Pressure') AS Intake_Pressure_min,
    max(max_value) FILTER (metric = 'Intake_Pressure') AS Intake_Pressure_max
  FROM (SELECT * FROM bins UNION ALL BY NAME SELECT * FROM dense)
  WHERE bin BETWEEN range_start AND range_end GROUP BY well, bin)""",
    "bins",
    "dense",
)
cte(
    "steps",
    """SELECT well, coalesce(quantile_cont(gap, 0.5), 60.0) AS step FROM (
  SELECT well, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY well ORDER BY ts)) / 1e6 AS gap FROM base)
GROUP BY well""",
    "base",
)
cte(
    "params",
    """SELECT well, CAST(greatest(round_even(1080 * 60 / step, 0), 3) AS BIGINT) // 2 AS half,
  CAST(round_even(720 * 60 / step, 0) AS BIGINT) AS fill FROM steps""",
    "steps",
)
_FRAME = "OVER (PARTITION BY well ORDER BY ts ROWS BETWEEN half PRECEDING AND half FOLLOWING)"
cte(
    "hampel1",
    f"SELECT *, {', '.join(f'abs({m} - quantile_cont({m}, 0.5) {_FRAME}) AS {m}_dev' for m in METRICS)} FROM base JOIN params USING (well)",
    "base",
    "params",
)
cte(
    "hampel2",
    "SELECT *, "
    + ", ".join(
        f"coalesce({m}_dev > 3.0 * 1.4826 * quantile_cont({m}_dev, 0.5) {_FRAME}, false) AS {m}_outlier" for m in METRICS
    )
    + " FROM hampel1",
    "hampel1",
)
cte(
    "hampel3",
    "SELECT well, ts, pos, fill, "
    + ", ".join(f"CASE WHEN NOT {m}_outlier THEN {m} END AS {m}" for m in METRICS)
    + ", "
    + ", ".join(f"CASE WHEN NOT Intake_Pressure_outlier THEN Intake_Pressure_{s} END AS Intake_Pressure_{s}" for s in ("min", "max"))
    + ", "
    + ", ".join(f"{m}_outlier" for m in METRICS)
    + " FROM hampel2",
    "hampel2",
)
cte(
    "flagged",
    "SELECT well, ts, pos, "
    + ", ".join(
        f"last_value({m} IGNORE NULLS) OVER (PARTITION BY well ORDER BY ts ROWS BETWEEN fill PRECEDING AND CURRENT ROW) AS {m}"
        for m in METRICS
    )
    + ", Intake_Pressure_min, Intake_Pressure_max, "
    + ", ".join(f"{m}_outlier, {m} AS {m}_kept" for m in METRICS)
    + " FROM hampel3",
    "hampel3",
)
cte(
    "clean",
    f"SELECT well, ts, pos, {', '.join(BASE)} FROM flagged",
    "flagged",
)
cte(
    "ann",
    """SELECT event_id AS row_id, 'w' || (user_id % 10) AS well,
  ['tubing_leak', 'inflow_drop', 'inflow_rise', 'normal_freq', 'normal_freq'][k % 5 + 1] AS cause,
  ts AS start_ts, ts + INTERVAL 24 HOUR AS end_ts, 'k=' || k AS notes
FROM (SELECT *, CAST(props ->> '$.k' AS INTEGER) AS k FROM events WHERE event_type = 'error')""",
)
cte(
    "labelled",
    """SELECT *, CASE WHEN cause IN ('tubing_leak', 'inflow_drop', 'inflow_rise') THEN 'anomaly'
  WHEN cause IN ('normal_freq') THEN 'normal' END AS label FROM ann""",
    "ann",
)
cte(
    "intervals",
    """SELECT row_id AS interval_id, row_id, well, label, cause, notes,
  greatest(coalesce(start_ts, lo), lo) AS start_ts, least(coalesce(end_ts, hi), hi) AS end_ts
FROM labelled JOIN (SELECT well, min(ts) AS lo, max(ts) AS hi FROM clean GROUP BY well) USING (well)
WHERE label IS NOT NULL AND greatest(coalesce(start_ts, lo), lo) < least(coalesce(end_ts, hi), hi)""",
    "labelled",
    "clean",
)
cte("anomalies", "SELECT * FROM intervals WHERE label = 'anomaly'", "intervals")
cte("normals", "SELECT * FROM intervals WHERE label = 'normal'", "intervals")
cte("train_normals", "SELECT * FROM normals WHERE well NOT IN ('w3', 'w7')", "normals")
cte(
    "grouped",
    """SELECT *, CASE cause WHEN 'tubing_leak' THEN 'leak' WHEN 'inflow_drop' THEN 'inflow'
  WHEN 'inflow_rise' THEN 'inflow' ELSE cause END AS cause_group FROM anomalies""",
    "anomalies",
)


def _long(source: str, keys: str, columns, name: str = "metric") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS {name}, {c} AS value FROM {source} WHERE {c} IS NOT NULL" for c in columns)


def _baseline(suffix: str, intervals: str) -> None:
    cte(
        f"points{suffix}",
        "SELECT metric, CAST(floor(frequency_value / 20.0) AS BIGINT) AS bin_index, value FROM ("
        + _long(
            f"(SELECT c.*, c.Frequency AS frequency_value FROM clean c JOIN {intervals} n ON c.well = n.well AND c.ts BETWEEN n.start_ts AND n.end_ts WHERE c.Frequency IS NOT NULL)",
            "frequency_value",
            MODELLED,
        )
        + ")",
        "clean",
        intervals,
    )
    cte(
        f"baseline{suffix}",
        f"""SELECT metric, bin_index, CAST((bin_index + 0.5) * 20 AS DOUBLE) AS frequency_center, count(*) AS "count", any_value(median) AS median,
  CASE WHEN quantile_cont(abs(value - median), 0.5) > 0 THEN 1.4826 * quantile_cont(abs(value - median), 0.5) ELSE 1e-6 END AS mad
FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY metric, bin_index) AS median FROM points{suffix})
GROUP BY metric, bin_index HAVING count(*) >= 10""",
        f"points{suffix}",
    )


_baseline("", "train_normals")
_baseline("_full", "normals")
cte("clean_long", _long("clean", "well, ts, Frequency", MODELLED), "clean")
cte(
    "fallbacks",
    """SELECT well, metric, 1.4826 * CASE WHEN quantile_cont(abs(value - median), 0.5) > 0 THEN quantile_cont(abs(value - median), 0.5)
  WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1.0 END AS fallback
FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY well, metric) AS median FROM clean_long) GROUP BY well, metric""",
    "clean_long",
)
cte(
    "window_steps",
    """SELECT well, metric, quantile_cont(gap, 0.5) AS step FROM (
  SELECT well, metric, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY well, metric ORDER BY ts)) / 1e6 AS gap FROM clean_long)
WHERE gap IS NOT NULL GROUP BY well, metric""",
    "clean_long",
)
cte(
    "windows",
    """SELECT well, metric, w, s, greatest(least(w, CAST(ceil(w * 1.0) AS BIGINT)), 1) AS mp FROM (
  SELECT well, metric, greatest(CAST(round_even(720 * 60 / step, 0) AS BIGINT), 1) AS w,
    greatest(CAST(round_even(360 * 60 / step, 0) AS BIGINT), 1) AS s FROM window_steps)""",
    "window_steps",
)


def _features(suffix: str) -> None:
    b = f"baseline{suffix}"
    cte(
        f"fills{suffix}",
        f"""SELECT well, metric, quantile_cont(mad, 0.5) AS found FROM clean JOIN {b} ON {b}.bin_index = CAST(floor(Frequency / 20.0) AS BIGINT)
WHERE Frequency IS NOT NULL GROUP BY well, metric""",
        "clean",
        b,
    )
    cte(
        f"known{suffix}",
        f"""SELECT well, metric, fallback FROM fallbacks WHERE metric IN (SELECT metric FROM {b})
AND well IN (SELECT well FROM clean WHERE Frequency IS NOT NULL)""",
        "fallbacks",
        "clean",
        b,
    )
    columns = []
    joins = []
    for m, n in MODELLED.items():
        joins.append(
            f"LEFT JOIN {b} b_{n} ON b_{n}.metric = '{m}' AND b_{n}.bin_index = CAST(floor(c.Frequency / 20.0) AS BIGINT) "
            f"LEFT JOIN known{suffix} f_{n} ON f_{n}.metric = '{m}' AND f_{n}.well = c.well "
            f"LEFT JOIN fills{suffix} g_{n} ON g_{n}.metric = '{m}' AND g_{n}.well = c.well "
            f"LEFT JOIN windows w_{n} ON w_{n}.metric = '{m}' AND w_{n}.well = c.well"
        )
        columns.append(
            f"c.{m} AS {n}, b_{n}.median AS {n}_expected, coalesce(c.{m} - b_{n}.median, c.{m}) AS {n}_residual, "
            f"CASE WHEN f_{n}.fallback IS NOT NULL THEN greatest(coalesce(b_{n}.mad, g_{n}.found, f_{n}.fallback), 0.1 * f_{n}.fallback, 0.05) END AS {n}_scale, "
            f"coalesce(w_{n}.w, 1) AS {n}_w, coalesce(w_{n}.s, 1) AS {n}_s, coalesce(w_{n}.mp, 1) AS {n}_mp"
        )
    cte(
        f"applied{suffix}",
        f"SELECT c.well, c.ts, c.pos, c.Frequency AS frequency, {', '.join(columns)} FROM clean c {' '.join(joins)}",
        "clean",
        b,
        f"known{suffix}",
        f"fills{suffix}",
        "windows",
    )
    rolled = []
    for n in NAMES:
        over = "OVER (PARTITION BY well ORDER BY ts ROWS BETWEEN"
        now = f"{over} {n}_w - 1 PRECEDING AND CURRENT ROW)"
        lagged = f"{over} {n}_w - 1 + {n}_s PRECEDING AND {n}_s PRECEDING)"
        rolled.append(f"CASE WHEN count({n}_residual) {now} >= {n}_mp THEN avg({n}_residual) {now} END AS {n}_now")
        rolled.append(f"CASE WHEN count({n}_residual) {lagged} >= {n}_mp THEN avg({n}_residual) {lagged} END AS {n}_lagged")
    cte(
        f"rolled{suffix}",
        f"""SELECT *, pressure_residual - lag(pressure_residual, CAST(pressure_s AS INTEGER)) OVER (PARTITION BY well ORDER BY ts) AS pressure_slope,
  {", ".join(f"{n}_residual / {n}_scale AS {n}_z" for n in NAMES)}, {", ".join(rolled)} FROM applied{suffix}""",
        f"applied{suffix}",
    )
    near = []
    for n in NAMES:
        v = f"CASE WHEN {n}_lagged IS NOT NULL THEN {{'us': epoch_us(ts), 'v': {n}_lagged}} END"
        near.append(f"last_value({v} IGNORE NULLS) OVER (PARTITION BY well ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}_p")
        near.append(f"first_value({v} IGNORE NULLS) OVER (PARTITION BY well ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {n}_n")
    cte(f"near{suffix}", f"SELECT *, {', '.join(near)} FROM rolled{suffix}", f"rolled{suffix}")
    filled = ", ".join(
        f"coalesce({n}_lagged, CASE WHEN {n}_n IS NOT NULL THEN ({n}_n.v - {n}_p.v) / ({n}_n.us - {n}_p.us) * (epoch_us(ts) - {n}_p.us) + {n}_p.v ELSE {n}_p.v END) AS {n}_before"
        for n in NAMES
    )
    cte(f"filled{suffix}", f"SELECT *, {filled} FROM near{suffix}", f"near{suffix}")
    deltas = ", ".join(f"({n}_now - {n}_before) / nullif({n}_before, 0) AS {n}_delta" for n in NAMES)
    cte(
        f"features{suffix}",
        f"SELECT well, ts, pos, {', '.join(FEATURES)} FROM (SELECT *, {deltas} FROM filled{suffix})",
        f"filled{suffix}",
    )


_features("")
_features("_full")
cte(
    "pool",
    "SELECT * FROM ("
    + _long("(SELECT f.* FROM features f JOIN train_normals n ON f.well = n.well AND f.ts BETWEEN n.start_ts AND n.end_ts)", "well, ts", DELTAS, "feature")
    + ") WHERE abs(value) <= CASE feature "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LIMITS.items())
    + " END",
    "features",
    "train_normals",
)
cte(
    "tails",
    """SELECT feature, value,
  -ln(count(*) OVER (PARTITION BY feature ORDER BY value RANGE UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY feature)) AS low,
  -ln(count(*) OVER (PARTITION BY feature ORDER BY value DESC RANGE UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY feature)) AS high,
  mean FROM pool JOIN (SELECT feature, avg(value) AS mean FROM pool GROUP BY feature) USING (feature)""",
    "pool",
)
cte(
    "tail_scores",
    """SELECT feature, value, greatest(low, high, CASE WHEN skew < 0 THEN low WHEN skew > 0 THEN high ELSE low + high END) AS score
FROM tails JOIN (SELECT feature, sign(sum((value - mean) ** 3)) AS skew FROM tails GROUP BY feature) USING (feature)""",
    "tails",
)
cte(
    "cuts",
    """SELECT feature, coalesce(min(abs(value)) FILTER (score > tight_cut), max(abs(value))) AS tight,
  coalesce(min(abs(value)) FILTER (score > loose_cut), max(abs(value))) AS loose
FROM tail_scores JOIN (SELECT feature, quantile_cont(score, 1.0 - 0.01) AS tight_cut, quantile_cont(score, 1.0 - 0.05) AS loose_cut
  FROM tail_scores GROUP BY feature) USING (feature) GROUP BY feature""",
    "tail_scores",
)
cte(
    "thresholds",
    """SELECT cause_group, min(row_id) AS first_row,
  greatest((SELECT tight FROM cuts WHERE feature = 'pressure_delta'), 0.01) AS thr_delta,
  CASE WHEN cause_group = 'inflow' THEN 0.03 ELSE greatest((SELECT tight FROM cuts WHERE feature = 'pressure_slope'), 0.01) END AS thr_slope,
  (SELECT loose FROM cuts WHERE feature = 'pressure_delta') AS normal_delta,
  (SELECT loose FROM cuts WHERE feature = 'pressure_slope') AS normal_slope
FROM grouped GROUP BY cause_group""",
    "grouped",
    "cuts",
)
cte(
    "used",
    """SELECT cause_group, well, start_ts, end_ts FROM grouped WHERE well NOT IN ('w3', 'w7')
UNION ALL SELECT 'normal', well, start_ts, end_ts FROM train_normals""",
    "grouped",
    "train_normals",
)
cte(
    "train_points",
    """SELECT cause_group, count(*) AS points FROM used u JOIN features f ON f.well = u.well AND f.ts BETWEEN u.start_ts AND u.end_ts
WHERE abs(pressure_delta) <= 10 GROUP BY cause_group""",
    "used",
    "features",
)
cte(
    "train_members",
    """SELECT DISTINCT cause_group, 'well' AS item, well AS name FROM used
UNION ALL SELECT DISTINCT cause_group, 'cause', cause FROM grouped""",
    "used",
    "grouped",
)
cte("causes", "SELECT well, arg_min(cause, row_id) AS cause FROM anomalies GROUP BY well", "anomalies")
cte(
    "resolved",
    """SELECT w.well, coalesce(c.cause, (SELECT arg_min(cause_group, first_row) FROM thresholds)) AS cause
FROM (SELECT DISTINCT well FROM clean) w LEFT JOIN causes c USING (well)""",
    "clean",
    "causes",
    "thresholds",
)
cte(
    "well_thresholds",
    """SELECT r.well, r.cause, r.cause_group, coalesce(t.thr_delta, f.thr_delta) AS thr_delta, coalesce(t.thr_slope, f.thr_slope) AS thr_slope,
  coalesce(t.normal_delta, f.normal_delta) AS normal_delta, coalesce(t.normal_slope, f.normal_slope) AS normal_slope
FROM (SELECT *, CASE cause WHEN 'tubing_leak' THEN 'leak' WHEN 'inflow_drop' THEN 'inflow' WHEN 'inflow_rise' THEN 'inflow' ELSE cause END AS cause_group FROM resolved) r
LEFT JOIN thresholds t USING (cause_group), (SELECT * FROM thresholds ORDER BY first_row LIMIT 1) f""",
    "resolved",
    "thresholds",
)
cte(
    "rules",
    """SELECT well, cause, cause_group, contains(cause, 'inflow') AS inflow, contains(cause, 'leak') AS leak, well IN ('w3', 'w7') AS holdout,
  thr_delta * CASE WHEN contains(cause, 'inflow') THEN 0.6 ELSE 1.0 END AS thr_delta,
  thr_slope * CASE WHEN contains(cause, 'inflow') THEN 0.6 ELSE 1.0 END AS thr_slope, normal_delta, normal_slope
FROM well_thresholds WHERE well IN (SELECT well FROM anomalies)""",
    "well_thresholds",
    "anomalies",
)
cte("refs", "SELECT a.* FROM anomalies a JOIN causes c ON a.well = c.well AND a.cause = c.cause", "anomalies", "causes")
cte(
    "z_pool",
    """SELECT f.pressure_z AS x, f.current_z AS y, f.temperature_z AS z FROM features f
JOIN train_normals n ON f.well = n.well AND f.ts BETWEEN n.start_ts AND n.end_ts""",
    "features",
    "train_normals",
)
cte("z_full", "SELECT * FROM z_pool WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL", "z_pool")
cte(
    "mcd_start",
    """SELECT mx, my, mz, 1 / (1.4826 * quantile_cont(abs(x - mx), 0.5)) ** 2 AS pxx, 1 / (1.4826 * quantile_cont(abs(y - my), 0.5)) ** 2 AS pyy,
  1 / (1.4826 * quantile_cont(abs(z - mz), 0.5)) ** 2 AS pzz, 0.0 AS pxy, 0.0 AS pxz, 0.0 AS pyz
FROM z_full, (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(z, 0.5) AS mz FROM z_full) GROUP BY mx, my, mz""",
    "z_full",
)


def _distance(model: str) -> str:
    return (
        f"SELECT *, (x-mx)**2*pxx + (y-my)**2*pyy + (z-mz)**2*pzz + 2*(x-mx)*(y-my)*pxy + 2*(x-mx)*(z-mz)*pxz + 2*(y-my)*(z-mz)*pyz AS d "
        f"FROM z_full, {model}"
    )


def _refit(name: str, chosen: str, *deps: str) -> None:
    cte(
        f"{name}_cov",
        f"""SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c,
  var_pop(y) AS d, covar_pop(y, z) AS e, var_pop(z) AS f FROM ({chosen})""",
        *deps,
    )
    cte(
        name,
        f"""SELECT mx, my, mz, (d*f - e*e) / det AS pxx, (c*e - b*f) / det AS pxy, (b*e - c*d) / det AS pxz,
  (a*f - c*c) / det AS pyy, (b*c - a*e) / det AS pyz, (a*d - b*b) / det AS pzz
FROM (SELECT *, a*(d*f - e*e) - b*(b*f - c*e) + c*(b*e - c*d) AS det FROM {name}_cov)""",
        f"{name}_cov",
    )


MCD_STEPS = 20
for _i in range(1, MCD_STEPS + 1):
    _model = f"mcd_step{_i - 1}" if _i > 1 else "mcd_start"
    cte(f"mcd_d{_i}", _distance(_model), "z_full", _model)
    # Copies of one point are as far as each other, so all of those on the border are chosen.
    cte(
        f"mcd_h{_i}",
        f"SELECT max(d) AS border FROM (SELECT d, row_number() OVER (ORDER BY d) AS nth, count(*) OVER () AS n FROM mcd_d{_i}) WHERE nth <= ceil(0.5 * (n + 4))",
        f"mcd_d{_i}",
    )
    _refit(f"mcd_step{_i}", f"SELECT * FROM mcd_d{_i}, mcd_h{_i} WHERE d <= border", f"mcd_d{_i}", f"mcd_h{_i}")
cte(f"mcd_d{MCD_STEPS + 1}", _distance(f"mcd_step{MCD_STEPS}"), "z_full", f"mcd_step{MCD_STEPS}")
_refit(
    "model",
    f"SELECT * FROM mcd_d{MCD_STEPS + 1} WHERE d / (SELECT quantile_cont(d, 0.5) / 2.365973884375338 FROM mcd_d{MCD_STEPS + 1}) < 9.348403604496148",
    f"mcd_d{MCD_STEPS + 1}",
)
cte("model_cut", f"SELECT quantile_cont(d, 0.99) AS threshold FROM ({_distance('model')})", "z_full", "model")
cte(
    "t2",
    """SELECT f.*, (pressure_z-mx)**2*pxx + (current_z-my)**2*pyy + (temperature_z-mz)**2*pzz + 2*(pressure_z-mx)*(current_z-my)*pxy
  + 2*(pressure_z-mx)*(temperature_z-mz)*pxz + 2*(current_z-my)*(temperature_z-mz)*pyz AS t2_stat, threshold FROM features f LEFT JOIN model ON true LEFT JOIN model_cut ON true""",
    "features",
    "model",
    "model_cut",
)
cte("z_long", _long("features", "well, ts, pos", [f"{n}_z" for n in NAMES]), "features")
cte(
    "averages",
    """SELECT well, metric, ts, pos, value, list_reduce(list(value) OVER (PARTITION BY well, metric ORDER BY ts), lambda p, x: 0.2 * x + 0.8 * p) AS ewma FROM z_long""",
    "z_long",
)
cte("averaged", "SELECT DISTINCT well, pos FROM averages WHERE abs(ewma) > 3.0", "averages")
cte(
    "scored",
    """SELECT t.*, coalesce(t2_stat > threshold, false) AS t2_flag, a.pos IS NOT NULL AS ewma_flag,
  coalesce(abs(pressure_z) > 4.0, false) OR coalesce(abs(current_z) > 4.0, false) OR coalesce(abs(temperature_z) > 4.0, false) AS spike_flag,
  coalesce(abs(pressure_delta) >= thr_delta AND abs(pressure_slope) >= thr_slope, false) AS base_flag,
  coalesce(abs(pressure_slope) >= thr_slope, false) AS steep, holdout, inflow, leak, thr_delta, thr_slope, cause,
  EXISTS (SELECT 1 FROM normals n WHERE n.well = t.well AND t.ts BETWEEN n.start_ts AND n.end_ts) AS in_normal
FROM t2 t JOIN rules r ON r.well = t.well LEFT JOIN averaged a ON a.well = t.well AND a.pos = t.pos""",
    "t2",
    "rules",
    "averaged",
    "normals",
)
cte(
    "signals",
    """SELECT *, base_flag OR residual_flag AS signal FROM (
  SELECT *, t2_flag AND spike_flag AND steep AND (holdout OR NOT in_normal) AS residual_flag FROM scored)""",
    "scored",
)
cte(
    "edges",
    """SELECT well, ts, pos FROM (SELECT *, coalesce(lag(signal) OVER (PARTITION BY well ORDER BY ts), false) AS was FROM signals)
WHERE signal AND NOT was""",
    "signals",
)
cte(
    "kept",
    """SELECT well, min(ts) AS ts FROM edges GROUP BY well
UNION ALL
SELECT k.well, (SELECT min(e.ts) FROM edges e WHERE e.well = k.well AND e.ts >= k.ts + INTERVAL 1440 MINUTE) AS ts
FROM kept k WHERE EXISTS (SELECT 1 FROM edges e WHERE e.well = k.well AND e.ts >= k.ts + INTERVAL 1440 MINUTE)""",
    "edges",
)
cte(
    "spots",
    """SELECT *, residual_flag OR ewma_flag OR spike_flag AS any_flag FROM signals
WHERE pressure_delta IS NOT NULL AND pressure_slope IS NOT NULL""",
    "signals",
)
cte(
    "near_refs",
    """SELECT r.well, r.row_id, r.start_ts, r.end_ts,
  arg_min(s.ts, abs(epoch_us(s.ts) - epoch_us(r.start_ts)) * 2 - CASE WHEN s.ts >= r.start_ts THEN 1 ELSE 0 END) AS ts
FROM refs r JOIN signals s USING (well) WHERE r.well NOT IN ('w3', 'w7') GROUP BY ALL""",
    "refs",
    "signals",
)
cte(
    "offers",
    """SELECT well, ts, 1 AS kind, epoch_us(ts) AS ord, NULL::BIGINT AS span_start, NULL::BIGINT AS span_end FROM kept
UNION ALL SELECT well, ts, 2, row_id, epoch_us(start_ts), epoch_us(end_ts) FROM near_refs""",
    "kept",
    "near_refs",
)
cte(
    "insides",
    """SELECT o.well, o.ts, arg_min(r.interval_id, r.row_id) AS inside FROM (SELECT DISTINCT well, ts FROM offers) o
JOIN refs r ON r.well = o.well AND o.ts BETWEEN r.start_ts AND r.end_ts GROUP BY o.well, o.ts""",
    "offers",
    "refs",
)
cte(
    "offered",
    """SELECT o.*, epoch_us(o.ts) AS us, row_number() OVER (PARTITION BY o.well ORDER BY kind, ord) AS nth, i.inside,
  CASE WHEN inflow THEN CASE WHEN any_flag AND abs(pressure_slope) >= 3.0 * thr_slope AND abs(pressure_delta) >= 3.0 * thr_delta THEN 43200000000 ELSE 0 END
    WHEN leak AND NOT (any_flag AND (abs(pressure_slope) >= 0.6 * thr_slope OR abs(pressure_delta) >= greatest(0.5 * thr_delta, 0.01))) THEN 0
    ELSE 9000000000000000000 END AS most
FROM offers o JOIN spots s ON s.well = o.well AND s.ts = o.ts LEFT JOIN insides i ON i.well = o.well AND i.ts = o.ts""",
    "offers",
    "spots",
    "insides",
)
cte(
    "ref_lists",
    """SELECT well, list({'away': 0::BIGINT, 'ord': row_id, 'id': interval_id, 'a': epoch_us(start_ts), 'b': epoch_us(end_ts)}) AS refs
FROM refs GROUP BY well""",
    "refs",
)
# One offer of every well a step: the state is what has been taken and when.
cte(
    "matching",
    """SELECT well, 0::BIGINT AS nth, []::VARCHAR[] AS taken, []::BIGINT[] AS times, NULL::TIMESTAMP AS ts, NULL::BIGINT AS interval_id, false AS supplemental FROM ref_lists
UNION ALL
SELECT well, nth, CASE WHEN ok THEN list_append(taken, name) ELSE taken END, CASE WHEN ok THEN list_append(times, us) ELSE times END,
  ts, CASE WHEN ok THEN chosen.id END, kind = 2
FROM (
  SELECT *, coalesce(NOT list_contains(taken, name) AND chosen.a - us <= most
    AND (kind = 1 OR len(list_filter(times, lambda t: t BETWEEN span_start AND span_end)) = 0), false) AS ok
  FROM (
    SELECT *, chosen.a || '-' || chosen.b AS name FROM (
      SELECT m.well, o.nth, m.taken, m.times, o.ts, o.us, o.kind, o.most, o.span_start, o.span_end,
        CASE WHEN o.inside IS NOT NULL THEN list_filter(l.refs, lambda r: r.id = o.inside)[1]
        ELSE list_sort(list_transform(list_filter(l.refs, lambda r: NOT list_contains(m.taken, r.a || '-' || r.b)),
          lambda r: {'away': abs(r.a - o.us), 'ord': r.ord, 'id': r.id, 'a': r.a, 'b': r.b}))[1] END AS chosen
      FROM matching m JOIN offered o ON o.well = m.well AND o.nth = m.nth + 1 JOIN ref_lists l ON l.well = m.well)))""",
    "offered",
    "ref_lists",
)
cte("matches", "SELECT well, ts, interval_id, supplemental FROM matching WHERE interval_id IS NOT NULL", "matching")
_LEAD = "(epoch_us(m.ts) - epoch_us(r.start_ts)) / 6e7"
RECORD_DOUBLES = (
    "duration_minutes", "pressure_delta_median", "pressure_slope_median", "current_delta_median", "temperature_delta_median",
    "pressure_mean", "pressure_min_15m", "pressure_max_15m", "t2_max", "current_mean", "temperature_mean", "frequency_mean", "score",
    "reference_delta_minutes", "reference_raw_delta_minutes", "reference_aligned_delta_minutes", "threshold_pressure_delta",
    "threshold_pressure_slope", "threshold_normal_pressure_delta", "threshold_normal_pressure_slope",
)
RECORD_REST = (
    "well", "cause", "start", "raw_start", "aligned_start", '"end"', "segment_type", "pressure_direction", "current_direction",
    "temperature_direction", "ewma_triggered", "spike_triggered", "residual_triggered", "reference_match", "reference_notes", "reference_start",
)
cte(
    "records",
    f"""SELECT m.well, s.cause, m.ts AS start, m.ts AS raw_start, m.ts AS aligned_start, m.ts AS "end", 0.0::DOUBLE AS duration_minutes,
  'anomaly' AS segment_type, s.pressure_delta AS pressure_delta_median, s.pressure_slope AS pressure_slope_median,
  s.current_delta AS current_delta_median, s.temperature_delta AS temperature_delta_median, DIRECTIONS,
  c.Intake_Pressure AS pressure_mean, c.Intake_Pressure_min AS pressure_min_15m, c.Intake_Pressure_max AS pressure_max_15m,
  s.ewma_flag AS ewma_triggered, s.spike_flag AS spike_triggered, s.t2_stat AS t2_max, s.residual_flag AS residual_triggered,
  c.Current AS current_mean, c.Motor_Temperature AS temperature_mean, c.Frequency AS frequency_mean, s.pressure_delta * s.pressure_slope AS score,
  'anomaly' AS reference_match, r.notes AS reference_notes, r.start_ts AS reference_start,
  {_LEAD} AS reference_delta_minutes, {_LEAD} AS reference_raw_delta_minutes, {_LEAD} AS reference_aligned_delta_minutes,
  s.thr_delta AS threshold_pressure_delta, s.thr_slope AS threshold_pressure_slope, u.normal_delta AS threshold_normal_pressure_delta,
  u.normal_slope AS threshold_normal_pressure_slope
FROM matches m JOIN signals s ON s.well = m.well AND s.ts = m.ts JOIN clean c ON c.well = m.well AND c.ts = m.ts
JOIN refs r ON r.interval_id = m.interval_id JOIN rules u ON u.well = m.well""",
    "matches",
    "signals",
    "clean",
    "refs",
    "rules",
)
cte(
    "quality",
    """SELECT count(*) AS reference_count, coalesce(sum(hits), 0)::BIGINT AS detections, count(*) - count(hits) AS missed,
  count(hits) / count(*) AS recall, sum(inside) / sum(hits) AS "precision", sum(delay) / sum(hits) AS mean_delay_minutes
FROM (SELECT DISTINCT well, start_ts, end_ts FROM refs) p LEFT JOIN (
  SELECT d.well, reference_start, count(*) AS hits, count(*) FILTER (start BETWEEN start_ts AND end_ts) AS inside, sum(reference_delta_minutes) AS delay
  FROM records d LEFT JOIN (SELECT DISTINCT well, start_ts, end_ts FROM refs) q ON q.well = d.well AND q.start_ts = d.reference_start GROUP BY ALL
) h ON h.well = p.well AND h.reference_start = p.start_ts""",
    "refs",
    "records",
)
cte(
    "live",
    """SELECT *, coalesce(abs(pressure_delta) >= thr_delta AND abs(pressure_slope) >= thr_slope, false) AS fires FROM (
  SELECT well, ts, newest, pressure_slope, thr_delta, thr_slope, (pressure_now - before) / nullif(before, 0) AS pressure_delta FROM (
    SELECT r.*, u.thr_delta, u.thr_slope, max(ts) OVER (PARTITION BY well) AS newest,
      last_value(pressure_lagged IGNORE NULLS) OVER (PARTITION BY well ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before
    FROM rolled r JOIN rules u USING (well)))
WHERE ts <= newest - INTERVAL 720 MINUTE""",
    "rolled",
    "rules",
)
cte(
    "live_edges",
    "SELECT well, ts FROM (SELECT *, coalesce(lag(fires) OVER (PARTITION BY well ORDER BY ts), false) AS was FROM live) WHERE fires AND NOT was",
    "live",
)
cte(
    "live_kept",
    """SELECT well, min(ts) AS ts FROM live_edges GROUP BY well
UNION ALL
SELECT k.well, (SELECT min(e.ts) FROM live_edges e WHERE e.well = k.well AND e.ts >= k.ts + INTERVAL 1440 MINUTE) AS ts
FROM live_kept k WHERE EXISTS (SELECT 1 FROM live_edges e WHERE e.well = k.well AND e.ts >= k.ts + INTERVAL 1440 MINUTE)""",
    "live_edges",
)
cte(
    "first_triggers",
    """SELECT a.well, a.interval_id, a.start_ts AS interval_start, a.end_ts AS interval_end, count(f.ts) AS evaluated_points,
  min(f.ts) FILTER (f.hit AND f.ts >= a.start_ts) AS detection_start
FROM anomalies a LEFT JOIN (SELECT x.*, coalesce(abs(pressure_delta) >= thr_delta AND abs(pressure_slope) >= thr_slope, false) AS hit
  FROM features x LEFT JOIN rules USING (well)) f ON f.well = a.well AND f.ts BETWEEN a.start_ts - INTERVAL 720 MINUTE AND a.end_ts
GROUP BY ALL""",
    "anomalies",
    "features",
    "rules",
)
cte(
    "triggers",
    f"""SELECT t.*, (epoch_us(detection_start) - epoch_us(interval_start)) / 6e7 AS delay_minutes, {", ".join(f"f.{d}" for d in DELTAS)}
FROM first_triggers t LEFT JOIN features f ON f.well = t.well AND f.ts = t.detection_start""",
    "first_triggers",
    "features",
)
cte(
    "interval_stats",
    """SELECT i.well, i.label, i.start_ts AS start, i.end_ts AS "end", (epoch_us(i.end_ts) - epoch_us(i.start_ts)) / 6e7 AS duration_minutes,
  avg(c.Intake_Pressure) AS pressure_mean, stddev_pop(c.Intake_Pressure) AS pressure_std, min(c.Intake_Pressure) AS pressure_min,
  max(c.Intake_Pressure) AS pressure_max, min(c.Intake_Pressure_min) AS pressure_min_15m, max(c.Intake_Pressure_max) AS pressure_max_15m,
  quantile_cont(f.pressure_delta, 0.5) AS pressure_delta_median, avg(f.pressure_delta) AS pressure_delta_mean,
  avg(c.Current) AS current_mean, stddev_pop(c.Current) AS current_std, quantile_cont(f.current_delta, 0.5) AS current_delta_median,
  avg(c.Motor_Temperature) AS temperature_mean, stddev_pop(c.Motor_Temperature) AS temperature_std,
  quantile_cont(f.temperature_delta, 0.5) AS temperature_delta_median, avg(c.Frequency) AS frequency_mean, i.notes, i.interval_id
FROM intervals i JOIN clean c ON c.well = i.well AND c.ts BETWEEN i.start_ts AND i.end_ts JOIN features_full f ON f.well = c.well AND f.ts = c.ts
GROUP BY i.well, i.label, i.start_ts, i.end_ts, i.notes, i.interval_id""",
    "intervals",
    "clean",
    "features_full",
)


def direction(column: str, name: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL THEN '?' WHEN {column} >= 0.1 THEN '↑↑' WHEN {column} >= 0.03 THEN '↑' "
        f"WHEN {column} <= -0.1 THEN '↓↓' WHEN {column} <= -0.03 THEN '↓' ELSE '=' END AS {name}"
    )


STAT_DOUBLES = (
    "duration_minutes", "pressure_mean", "pressure_std", "pressure_min", "pressure_max", "pressure_min_15m", "pressure_max_15m",
    "pressure_delta_median", "pressure_delta_mean", "current_mean", "current_std", "current_delta_median",
    "temperature_mean", "temperature_std", "temperature_delta_median", "frequency_mean",
)
SUMMARY_COLUMNS = (
    "pressure_mean", "pressure_delta_median", "pressure_min_15m", "pressure_max_15m",
    "current_mean", "current_delta_median", "temperature_mean", "temperature_delta_median",
)
cte("stats_long", _long("interval_stats", "label", SUMMARY_COLUMNS, '"column"'), "interval_stats")
_deps, _records = CTE["records"]
CTE["records"] = (_deps, _records.replace("DIRECTIONS", ", ".join(direction(f"s.{n}_delta", f"{n}_direction") for n in NAMES)))
RECORDS = f"SELECT {', '.join(RECORD_REST)}, {r6(*RECORD_DOUBLES)} FROM records"
