"""Column-level rules: typing, safe arithmetic, labels, thresholds and time."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellspark.schema import MINUTE, CauseRules, Directions

# fixed values: accepted timestamp layouts, day first, tried in this order
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "d.M.yyyy H:mm:ss[.SSSSSS]",
    "d.M.yyyy H:mm",
    "d.M.yyyy",
    "d/M/yyyy H:mm:ss[.SSSSSS]",
    "d/M/yyyy H:mm",
    "d/M/yyyy",
    "d-M-yyyy H:mm:ss[.SSSSSS]",
    "d-M-yyyy H:mm",
    "d-M-yyyy",
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Microseconds since the epoch of a wall-clock timestamp."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def floor_div(a, b: int) -> Column:
    """Integer quotient rounded down."""
    a, b = _col(a), F.lit(int(b)).cast("bigint")
    return F.call_function("div", a - F.pmod(a, b), b)


def from_micros(us) -> Column:
    return F.timestamp_micros(_col(us)).cast("timestamp_ntz")


def minutes_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MINUTE))


def finite(c) -> Column:
    """NaN and infinities become null, so comparisons behave."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def coerce_ts(c) -> Column:
    """Day-first text to a UTC wall-clock timestamp; unreadable text gives null, a trailing offset is applied."""
    raw = F.trim(_col(c).cast("string"))
    zone = F.regexp_extract(raw, r"(?<=:\d\d(\.\d{1,6})?)\s*(Z|[+-]\d\d:?\d\d)$", 2)
    text = F.regexp_replace(raw, r"(?<=:\d\d(\.\d{1,6})?)\s*(Z|[+-]\d\d:?\d\d)$", "")
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    size = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    minutes = F.when(F.startswith(zone, F.lit("-")), -size).otherwise(size)
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in TIMESTAMP_FORMATS]).cast("timestamp_ntz")
    return parsed - F.make_dt_interval(mins=F.coalesce(minutes, F.lit(0)))


def coerce_num(c) -> Column:
    """Numeric text to double; unreadable text, NaN and infinity give null."""
    return finite(F.trim(_col(c).cast("string")).try_cast("double"))


def canon_well(c) -> Column:
    """Well ids are compared as trimmed text, and ``495.0`` read from a numeric column is ``495``."""
    text = F.regexp_replace(F.trim(_col(c).cast("string")), r"^(\d+)\.0+$", "$1")
    return F.nullif(text, F.lit(""))


def safe_divide(a, b) -> Column:
    return finite(F.try_divide(_col(a), _col(b)))


def direction(delta, cfg: Directions = Directions()) -> Column:
    d = _col(delta)
    return (
        F.when(d.isNull() | F.isnan(d), "?")
        .when(d >= cfg.strong_increase, "↑↑")
        .when(d >= cfg.mild_increase, "↑")
        .when(d <= cfg.strong_drop, "↓↓")
        .when(d <= cfg.mild_drop, "↓")
        .otherwise("=")
    )


def overlaps(start_a, end_a, start_b, end_b) -> Column:
    """Closed intervals share at least one instant."""
    return (_col(end_a) >= _col(start_b)) & (_col(start_a) <= _col(end_b))


def _mentions(c: Column, fragments: Iterable[str]) -> Column:
    hit = F.lit(False)
    for fragment in fragments:
        hit = hit | c.contains(fragment)
    return F.coalesce(hit, F.lit(False))


def is_inflow(cause, rules: CauseRules) -> Column:
    return _mentions(_col(cause), rules.inflow_fragments)


def is_leak(cause, rules: CauseRules) -> Column:
    return _mentions(_col(cause), rules.leak_fragments)


def soften(threshold, inflow, factor: float = 0.6) -> Column:
    return F.when(_col(inflow), _col(threshold) * factor).otherwise(_col(threshold))


def base_signal(delta, slope, thr_delta, thr_slope) -> Column:
    """Both the relative delta and the slope reach their thresholds; a missing value never triggers."""
    both = (F.abs(_col(delta)) >= _col(thr_delta)) & (F.abs(_col(slope)) >= _col(thr_slope))
    return F.coalesce(both, F.lit(False))


def most_lead(delta, slope, any_flag, thr_delta, thr_slope, inflow, leak, guard_hours: float = 12) -> Column:
    """Microseconds by which an event may be before its reference (thresholds already softened); 0 where it may not."""
    d, s, flag = F.abs(_col(delta)), F.abs(_col(slope)), _col(any_flag)
    thr_d, thr_s = _col(thr_delta), _col(thr_slope)
    inflow_ok = flag & (s >= 3.0 * thr_s) & (d >= 3.0 * thr_d)
    leak_ok = flag & ((s >= 0.6 * thr_s) | (d >= F.greatest(0.5 * thr_d, F.lit(0.01))))
    guard, never, always = (F.lit(int(x)).cast("bigint") for x in (guard_hours * 60 * MINUTE, 0, (1 << 63) - 1))
    return F.when(_col(inflow), F.when(inflow_ok, guard).otherwise(never)).when(_col(leak) & ~leak_ok, never).otherwise(always)


def early_gate(lead_us, delta, slope, any_flag, thr_delta, thr_slope, inflow, leak, guard_hours: float = 12) -> Column:
    """Whether an event ``lead_us`` before its reference may stand."""
    return _col(lead_us) <= most_lead(delta, slope, any_flag, thr_delta, thr_slope, inflow, leak, guard_hours)


def score(delta, slope) -> Column:
    return _col(delta) * _col(slope)


def freq_bin(x, width: float) -> Column:
    return F.floor(finite(x) / F.lit(float(width)))


def bin_center(index, width: float) -> Column:
    return (_col(index) + F.lit(0.5)) * F.lit(float(width))


def notes_list(columns: Sequence[str]) -> Column:
    """Trimmed non-empty comment cells, in column order."""
    if not columns:
        return F.array().cast("array<string>")
    cells = F.array(*[F.trim(F.col(f"`{c}`").cast("string")) for c in columns])
    return F.filter(cells, lambda x: x.isNotNull() & (x != ""))


def notes_text(c) -> Column:
    return F.coalesce(F.concat_ws("; ", _col(c)), F.lit(""))


def classify_label(cause, anomaly: Sequence[str], normal: Sequence[str]) -> Column:
    """``anomaly`` wins over ``normal``; causes in neither set give null."""
    c = F.trim(_col(cause))
    return F.when(c.isin(list(anomaly)), "anomaly").when(c.isin(list(normal)), "normal")


def normalize_labels(c) -> Column:
    """Array of raw labels to its distinct trimmed non-empty members, sorted."""
    return F.array_sort(
        F.array_distinct(F.filter(F.transform(_col(c), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    )


def label_set(value, default: Sequence[str] = ()) -> tuple[str, ...]:
    """Settings-side counterpart of :func:`normalize_labels`: one label or many, with a default."""
    if value is None:
        value = default
    items = [value] if isinstance(value, str) or not isinstance(value, Iterable) else list(value)
    texts = [str(item).strip() for item in items if item is not None]
    return tuple(dict.fromkeys(t for t in texts if t)) or tuple(default)
