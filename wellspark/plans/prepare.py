"""Shared front half of both workflows: grid, cleaning, intervals."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.operators.align import base_metrics, build_base, extrema_columns, pressure_fast
from wellspark.operators.baseline import build_baseline
from wellspark.operators.clean import clean
from wellspark.operators.features import feature_frame
from wellspark.operators.intervals import bucketed_coverage, reference_intervals, split_holdout
from wellspark.schema import DetectSettings
from wellspark.staging import stage


@dataclass
class Prepared:
    """Telemetry and annotations with each later table staged on first use."""

    telemetry: DataFrame
    annotations: DataFrame
    cfg: DetectSettings

    @cached_property
    def raw_base(self) -> DataFrame:
        return stage(build_base(self.telemetry, self.cfg.align), "base")

    @property
    def metrics(self) -> list[str]:
        return base_metrics(self.raw_base, self.cfg.align)

    @cached_property
    def flagged(self) -> DataFrame:
        return stage(clean(self.raw_base, self.cfg.clean, self.metrics), "clean")

    @cached_property
    def base(self) -> DataFrame:
        extrema = [c for c in extrema_columns(self.cfg.align) if c in self.flagged.columns]
        return self.flagged.select("well", "ts", "pos", *self.metrics, *extrema)

    @property
    def pressure_fast(self) -> DataFrame:
        return pressure_fast(self.telemetry, self.cfg.align)

    @cached_property
    def intervals(self) -> DataFrame:
        return stage(reference_intervals(self.annotations, self.base, self.cfg.causes), "intervals")

    @property
    def anomalies(self) -> DataFrame:
        return self.intervals.where(F.col("label") == "anomaly")

    @property
    def normals(self) -> DataFrame:
        return self.intervals.where(F.col("label") == "normal")

    @property
    def train_normals(self) -> DataFrame:
        return split_holdout(self.normals, self.cfg.holdout)

    @cached_property
    def normal_segments(self) -> DataFrame:
        """Where normal intervals lie, and how many: what all pooling over them joins with."""
        return bucketed_coverage(self.normals)

    @cached_property
    def train_segments(self) -> DataFrame:
        return bucketed_coverage(self.train_normals)

    @cached_property
    def baseline(self) -> DataFrame:
        """Fitted on the training wells only."""
        return stage(build_baseline(self.base, self.train_segments, self.cfg.baseline), "baseline")

    @cached_property
    def full_baseline(self) -> DataFrame:
        """Fitted on every normal interval, as the reference analysis does."""
        return stage(build_baseline(self.base, self.normal_segments, self.cfg.baseline), "baseline-full")

    def features_with(self, baseline: DataFrame) -> DataFrame:
        extrema = [c for c in self.base.columns if c.endswith(("_min", "_max"))]
        rows = feature_frame(self.base, baseline, self.cfg.features, self.cfg.baseline, extrema)
        return stage(rows, "features")

    @cached_property
    def features(self) -> DataFrame:
        return self.features_with(self.baseline)
