"""Detection workflow: from telemetry and annotations to matched detection records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.operators.evaluate import calibration_values, describe_triggers, first_triggers, quality
from wellspark.operators.events import detection_records, event_starts, match_references, score_points
from wellspark.operators.intervals import cause_references, map_groups, train_or_all, well_causes
from wellspark.operators.residual import ResidualModel, fit_residual_model
from wellspark.operators.summaries import training_summary
from wellspark.operators.thresholds import group_thresholds, well_rules
from wellspark.plans.prepare import Prepared
from wellspark.staging import stage, together


@dataclass
class Detection(Prepared):
    @cached_property
    def model(self) -> ResidualModel | None:
        return fit_residual_model(self.features, self.train_segments, self.cfg.residual)

    @cached_property
    def thresholds(self) -> DataFrame:
        pool = self.normal_segments if self.train_normals.isEmpty() else self.train_segments
        return stage(group_thresholds(self.features, self.intervals, pool, self.cfg), "thresholds")

    @cached_property
    def rules(self) -> DataFrame:
        return stage(well_rules(self.intervals, self.thresholds, self.cfg), "rules")

    @cached_property
    def references(self) -> DataFrame:
        return stage(cause_references(self.intervals, well_causes(self.intervals)), "references")

    @cached_property
    def scored(self) -> DataFrame:
        spark = self.features.sparkSession
        together(spark, lambda: self.model, lambda: self.rules, lambda: self.references, lambda: self.normal_segments)
        return stage(score_points(self.features, self.rules, self.model, self.normal_segments, self.cfg), "scored")

    @cached_property
    def events(self) -> DataFrame:
        return stage(event_starts(self.scored, self.cfg.gap_minutes), "events")

    @cached_property
    def matches(self) -> DataFrame:
        found = match_references(self.events, self.references, self.scored, self.rules, self.cfg)
        return stage(found, "matches")

    @property
    def records(self) -> DataFrame:
        """All detections; order by (start, well, segment_type) when writing."""
        return detection_records(self.matches, self.scored, self.base, self.references, self.rules, self.cfg)

    def triggers(self, wells=None) -> DataFrame:
        """First trigger of each anomaly interval, of the given wells or all."""
        spans = self.anomalies if wells is None else self.anomalies.where(F.col("well").isin(list(wells)))
        return first_triggers(self.features, spans, self.rules, self.cfg.features)

    @property
    def calibration(self) -> DataFrame:
        """Trigger values of the training intervals per cause group; thresholds do not depend on them."""
        grouped = map_groups(self.anomalies, self.cfg.causes)
        trained = train_or_all(grouped, self.cfg.holdout, ["cause_group"])
        found = first_triggers(self.features, trained, self.rules, self.cfg.features)
        return calibration_values(found, trained)

    def holdout_report(self, wells=None) -> DataFrame:
        held = [w for w in self.cfg.holdout if wells is None or w in set(wells)]
        return self.triggers(held).withColumn("description", describe_triggers())

    @property
    def training(self) -> DataFrame:
        return training_summary(self.features, self.intervals, self.cfg.causes, self.cfg.holdout)

    @property
    def quality(self) -> DataFrame:
        return quality(self.records, self.references)
