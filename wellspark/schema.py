"""Settings and the table layouts every operator agrees on."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

METRICS = ("Intake_Pressure", "Current", "Motor_Temperature", "Frequency")
PRESSURE = "Intake_Pressure"
FREQUENCY = "Frequency"

# Feature-name prefix of each modelled metric, in the column order of the feature frame.
MODELLED = {"Intake_Pressure": "pressure", "Current": "current", "Motor_Temperature": "temperature"}

TELEMETRY = "well string, metric string, ts timestamp_ntz, value double, row_id bigint"
ANNOTATIONS = (
    "row_id bigint, well string, cause string, start_ts timestamp_ntz, end_ts timestamp_ntz, notes array<string>"
)
INTERVALS = (
    "interval_id bigint, row_id bigint, well string, start_ts timestamp_ntz, end_ts timestamp_ntz, "
    "label string, cause string, notes array<string>"
)

MINUTE = 60_000_000  # microseconds
DAY = 24 * 60 * MINUTE


@dataclass(frozen=True)
class AlignSettings:
    frequency: str = "15min"
    aggregation: str = "mean"
    metrics: tuple[str, ...] | None = None  # None: METRICS and all others of the telemetry
    extrema: tuple[str, ...] = (PRESSURE,)


@dataclass(frozen=True)
class CleanSettings:
    hampel_minutes: float = 45.0
    n_sigma: float = 3.0
    fill_minutes: float = 30.0

    @property
    def active(self) -> bool:
        return self.hampel_minutes > 0 and self.n_sigma > 0


@dataclass(frozen=True)
class FeatureSettings:
    window_minutes: float = 60
    shift_minutes: float = 60
    min_samples: float = 30


@dataclass(frozen=True)
class BaselineSettings:
    enabled: bool = True
    bin_width: float = 2.0
    min_points: int = 10
    metrics: tuple[str, ...] = tuple(MODELLED)


@dataclass(frozen=True)
class ResidualSettings:
    enabled: bool = True
    ewma_lambda: float = 0.2
    ewma_limit: float = 3.0
    spike_limit: float = 4.0
    t2_alpha: float = 0.01
    min_points: int = 30
    max_steps: int = 20


@dataclass(frozen=True)
class Directions:
    strong_increase: float = 0.1
    mild_increase: float = 0.03
    mild_drop: float = -0.03
    strong_drop: float = -0.1


@dataclass(frozen=True)
class CauseProfile:
    name: str
    group: str | None = None
    include_normal: bool = True


@dataclass(frozen=True)
class CauseRules:
    """Which annotation causes count as what, and how their groups are treated."""

    # fixed values: default labels, family name fragments and the group with pinned thresholds
    anomaly: tuple[str, ...] = ("Негерметичность НКТ",)
    normal: tuple[str, ...] = ("Нормальная работа при изменении частоты",)
    inflow_fragments: tuple[str, ...] = ("Приток", "Кпрод", "Уменьш")
    leak_fragments: tuple[str, ...] = ("Негермет",)
    pinned_slope: dict[str, float] = field(default_factory=lambda: {"Приток": 0.03})
    profiles: tuple[CauseProfile, ...] = ()
    softening: float = 0.6

    def groups(self) -> dict[str, str]:
        """Cause name to group name; nameless profiles are ignored, an empty group falls back to the name."""
        named = [(p.name.strip(), (p.group or "").strip()) for p in self.profiles if (p.name or "").strip()]
        return {name: group or name for name, group in named}


@dataclass(frozen=True)
class DetectSettings:
    align: AlignSettings = AlignSettings()
    clean: CleanSettings = CleanSettings()
    features: FeatureSettings = FeatureSettings()
    baseline: BaselineSettings = BaselineSettings()
    residual: ResidualSettings = ResidualSettings()
    directions: Directions = Directions()
    causes: CauseRules = field(default_factory=CauseRules)
    contamination: float = 0.01
    normal_contamination: float = 0.05
    threshold_floor: float = 0.01
    gap_minutes: float = 10
    early_guard_hours: float = 12
    holdout: tuple[str, ...] = ()
    percentiles: tuple[float, ...] = (0.1, 0.5, 0.9)

    def with_(self, **changes) -> "DetectSettings":
        return replace(self, **changes)


_UNITS = {"t": MINUTE, "min": MINUTE, "s": 1_000_000, "h": 60 * MINUTE, "d": DAY}


def frequency_micros(text: str) -> int:
    """Microseconds of a grid step such as ``15T``, ``15min``, ``6h``, ``30s`` or ``1D``."""
    match = re.fullmatch(r"\s*(\d+(?:\.\d+)?)?\s*(T|min|s|h|D)\s*", text, re.IGNORECASE)
    step = int(float(match.group(1) or 1) * _UNITS[match.group(2).lower()]) if match else 0
    if step <= 0:
        raise ValueError(f"unsupported grid frequency {text!r}")
    return step
