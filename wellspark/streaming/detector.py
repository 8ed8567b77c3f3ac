"""Event starts on a live grid stream, against frozen thresholds and a frozen baseline.

Every well has a watermark of its own: the time of its newest row less the allowed delay. Rows wait in state until
the watermark passes them and are then taken in time order, however they arrived. A row that comes when later ones
have been taken is late: it changes nothing and is given out as such, so late rows can be counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wellspark.functions.scalar import freq_bin, micros
from wellspark.operators.baseline import baseline_by_bin
from wellspark.schema import FREQUENCY, MINUTE, PRESSURE

_OUT = "well string, ts timestamp_ntz, kind string, pressure_delta double, pressure_slope double"
_LAST = "history array<double>, before double, signal boolean, event_us bigint, taken_us bigint, newest_us bigint"
_NEVER = -(1 << 62)
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Detector(StatefulProcessor):
    """One well: the rows that wait, the last ``w + s`` residuals, the last comparison mean, signal and event."""

    def __init__(self, gap_us: int, delay_us: int):
        self.gap, self.delay = gap_us, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "us bigint, residual double")
        self.last = handle.getValueState("last", _LAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        history, before, signal, event, taken, newest = self.last.get() or ([], None, False, _NEVER, _NEVER, _NEVER)
        held = list(self.waiting.get())
        us, x = [np.array([h[0] for h in held], dtype=np.int64)], [np.array([h[1] for h in held], dtype=float)]
        limits = None
        for part in rows:
            own = part["us"].to_numpy(dtype=np.int64)
            late = own <= taken
            if late.any():
                yield self._output(key[0], "late", own[late], np.nan, np.nan)
            us.append(own[~late])
            x.append(part["residual"].to_numpy(dtype=float)[~late])
            limits = part.iloc[0] if limits is None else limits
        us, x = np.concatenate(us), np.concatenate(x)
        newest = max(newest, int(us.max(initial=_NEVER)))
        order = np.argsort(us, kind="stable")
        us, x = us[order], x[order]
        due = us <= newest - self.delay
        self.waiting.clear()
        if not due.all():
            self.waiting.put([(int(a), float(b)) for a, b in zip(us[~due], x[~due])])
        if due.any():
            us, x, past = us[due], x[due], len(history)
            w, s, mp = (int(limits[c]) for c in ("w", "s", "mp"))
            whole = pd.Series(np.concatenate((np.array(history, dtype=float), x)))
            now = whole.rolling(w, min_periods=mp).mean()
            # Where the comparison mean is missing the last known one is held.
            lagged = now.shift(s)[past:].reset_index(drop=True)
            if before is not None and pd.isna(lagged[0]):
                lagged[0] = before
            lagged = lagged.ffill().to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                delta = np.where(lagged == 0, np.nan, (now.to_numpy()[past:] - lagged) / lagged)
            slope = (whole - whole.shift(s)).to_numpy()[past:]
            fires = (np.abs(delta) >= limits["thr_delta"]) & (np.abs(slope) >= limits["thr_slope"])
            edges = np.flatnonzero(fires & ~np.concatenate(([signal], fires[:-1])))
            kept = []
            at = np.searchsorted(us[edges], event + self.gap)
            while at < len(edges):
                kept.append(edges[at])
                event = int(us[edges[at]])
                at = max(at + 1, np.searchsorted(us[edges], event + self.gap))
            if kept:
                yield self._output(key[0], "event", us[kept], delta[kept], slope[kept])
            history = whole.to_numpy()[-(w + s) :].tolist()
            before = None if np.isnan(lagged[-1]) else float(lagged[-1])
            signal, taken = bool(fires[-1]), int(us[-1])
        self.last.update((history, before, signal, event, taken, newest))

    @staticmethod
    def _output(well: str, kind: str, us: np.ndarray, delta, slope) -> pd.DataFrame:
        return pd.DataFrame({"well": well, "ts": us.astype("datetime64[us]"), "kind": kind, "pressure_delta": delta, "pressure_slope": slope})


def detect_stream(
    grid: DataFrame, baseline: DataFrame, rules: DataFrame, bin_width: float, gap_minutes: float, delay_minutes: float = 0
) -> DataFrame:
    """``(well, ts, kind, pressure_delta, pressure_slope)``: rising edges of the base signal, at least ``gap_minutes``
    apart per well (kind ``event``), and the rows that came more than ``delay_minutes`` late (kind ``late``).

    ``grid`` streams ``(well, ts, Intake_Pressure, Frequency)`` in any order; ``rules`` holds ``thr_delta, thr_slope, w,
    s, mp`` per well. A task holds a well's rows of one micro-batch and those that wait, so a source should bound
    its micro-batches. State is kept in the provider that lists in state need, which is set for the session.
    """
    grid.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    expected = baseline_by_bin(baseline, (PRESSURE,)).select(F.col("bin_index").alias("_bin"), F.col(f"{PRESSURE}_expected").alias("_exp"))
    rows = (
        grid.withColumn("_bin", freq_bin(FREQUENCY, bin_width))
        .join(expected, "_bin", "left")
        .join(rules.select("well", "thr_delta", "thr_slope", "w", "s", "mp"), "well")
        .select("well", micros("ts").alias("us"), F.coalesce(F.col(PRESSURE) - F.col("_exp"), F.col(PRESSURE)).alias("residual"), "thr_delta", "thr_slope", "w", "s", "mp")
    )
    step = Detector(int(gap_minutes * MINUTE), int(delay_minutes * MINUTE))
    return rows.groupBy("well").transformWithStateInPandas(step, _OUT, "Append", "None")
