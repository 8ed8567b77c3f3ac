"""Reference analysis: statistics of the labelled intervals themselves."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from wellspark.operators.summaries import interval_stats, label_summary
from wellspark.plans.prepare import Prepared
from wellspark.staging import stage


@dataclass
class ReferenceAnalysis(Prepared):
    """Unlike detection, the baseline is fitted on every normal interval, holdout wells included."""

    @cached_property
    def features(self) -> DataFrame:
        return self.features_with(self.full_baseline)

    @cached_property
    def stats(self) -> DataFrame:
        rows = interval_stats(self.features, self.intervals, self.cfg.directions)
        return stage(rows, "interval-stats")

    @property
    def summary(self) -> DataFrame:
        return label_summary(self.stats, self.cfg.percentiles)
