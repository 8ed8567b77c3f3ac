"""Outlier thresholds from normal operation, per cause group."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wellspark.functions.scalar import is_inflow, is_leak, soften
from wellspark.operators.baseline import unpivot
from wellspark.operators.intervals import bucketed_coverage, map_groups, weigh_points, well_causes
from wellspark.operators.quantiles import weighed
from wellspark.schema import CauseRules, DetectSettings
from wellspark.staging import stage

# fixed values: largest magnitude of a feature that still takes part in fitting
FEATURE_LIMITS = {"pressure_delta": 10.0, "pressure_slope": 20.0, "current_delta": 10.0, "temperature_delta": 10.0}


def pool_features(features: DataFrame, intervals: DataFrame) -> DataFrame:
    """Usable feature values inside the intervals: ``(well, ts, feature, value, weight)``.

    ``weight`` is the number of intervals that hold the point.
    """
    names = list(FEATURE_LIMITS)
    inside = weigh_points(features.select("well", "ts", *names), bucketed_coverage(intervals))
    rows = unpivot(inside, ["well", "ts", "weight"], names).withColumnRenamed("metric", "feature")
    limit = F.create_map(*[F.lit(x) for pair in FEATURE_LIMITS.items() for x in pair])[F.col("feature")]
    return rows.where(F.abs("value") <= limit)


def _score(upto: Column, atleast: Column) -> Column:
    """Tail score of values from the numbers of rows at or below and at or above them: the negative log of the
    empirical tail probability, on the side the distribution is skewed to or the rarer side, whichever is larger."""
    left, right = -F.log(upto / F.col("_n")), -F.log(atleast / F.col("_n"))
    sided = F.when(F.col("_skew") < 0, left).when(F.col("_skew") > 0, right).otherwise(left + right)
    return F.greatest(left, right, sided)


def _tail_bins(pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The values with their bins, and per bin between which scores those of its values lie:
    ``(feature, _bin, _in, _below, _n, _skew, least, most, low, high)``."""
    values = weighed(pool, ["feature"], "value", "weight")
    away = F.abs("_v")
    counted = values.groupBy("feature", "_bin").agg(
        F.sum("_c").alias("_in"),
        F.sum(F.col("_c") * F.col("_v")).alias("_sum"),
        F.min(away).alias("least"),
        F.max(away).alias("most"),
        (F.min("_v") == F.max("_v")).alias("_single"),
    )
    counted = stage(counted, "tail-bins")
    means = counted.groupBy("feature").agg((F.sum("_sum") / F.sum("_in")).alias("_mean"))
    off = F.col("_v") - F.col("_mean")
    skew = values.join(means, "feature").groupBy("feature").agg(F.signum(F.sum(F.col("_c") * off * off * off)).alias("_skew"))
    order = Window.partitionBy("feature").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    below, whole = F.sum("_in").over(order) - F.col("_in"), F.sum("_in").over(Window.partitionBy("feature"))
    placed = counted.withColumns({"_below": below, "_n": whole}).join(skew, "feature")
    # The fewest and the most rows that a value of the bin has on either side.
    inside, above = F.col("_below") + F.col("_in"), F.col("_n") - F.col("_below")
    low = _score(inside, above)
    high = F.when(F.col("_single"), low).otherwise(_score(F.col("_below") + 1, above - F.col("_in") + 1))
    return values, stage(placed.withColumns({"low": low, "high": high}).drop("_sum", "_single"), "tail-bounds")


def tail_thresholds(pool: DataFrame, contamination: Mapping[str, float]) -> DataFrame:
    """Per feature the smallest magnitude scored as an outlier: ``(feature, <name>…)``.

    A value is an outlier if its tail score is above a quantile of all scores. Scores of whole bins of values are bounded
    by counts. The order statistics of all lower and of all upper bounds enclose that quantile's ranks, so only values
    of bins that reach in between are exchanged and scored; all other bins are outliers, or are not, as a whole.
    Where nothing is an outlier the threshold is the largest magnitude. Features without values are absent.
    """
    values, bins = _tail_bins(pool)
    ranks = {f"{name}_{side}": f((F.lit(1.0 - c)) * (F.col("_n") - 1)) for name, c in contamination.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    upto = {b: F.sum("_in").over(Window.partitionBy("feature").orderBy(b)) for b in ("low", "high")}
    summed = bins.withColumns({f"_upto_{b}": c for b, c in upto.items()})
    bounds = [F.min(F.when(F.col(f"_upto_{b}") > k, F.col(b))).alias(f"{r}_{b}") for r, k in ranks.items() for b in ("low", "high")]
    marked = bins.join(summed.groupBy("feature").agg(*bounds), "feature")
    open_ = reduce(lambda a, b: a | b, [(F.col("high") >= F.col(f"{r}_low")) & (F.col("low") <= F.col(f"{r}_high")) for r in ranks])
    marked = stage(marked.withColumn("_open", open_), "tail-marks")

    near = values.join(marked.where("_open").select("feature", "_bin", "_below", "_n", "_skew"), ["feature", "_bin"])
    near = near.groupBy("feature", "_bin", "_v", "_below", "_n", "_skew").agg(F.sum("_c").alias("_c"))
    inside = Window.partitionBy("feature", "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.sum("_c").over(inside) + F.col("_below")
    scored = near.withColumn("_upto", reach).withColumn("score", _score(F.col("_upto"), F.col("_n") - F.col("_upto") + F.col("_c")))
    scored = scored.withColumn("_order", F.sum("_c").over(Window.partitionBy("feature").orderBy("score")))
    scored = stage(scored.select("feature", F.abs("_v").alias("size"), "score", "_order"), "tail-scores")

    closed = ~F.col("_open")
    under = [F.coalesce(F.sum(F.when(closed & (F.col("high") < F.col(f"{r}_low")), F.col("_in"))), F.lit(0)).alias(f"{r}_under") for r in ranks]
    sure = [F.min(F.when(closed & (F.col("low") > F.col(f"{n}_hi_high")), F.col("least"))).alias(f"{n}_sure") for n in contamination]
    totals = marked.groupBy("feature").agg(F.first("_n").alias("_n"), F.max("most").alias("most"), *under, *sure)
    met = scored.join(totals, "feature")
    picks = [F.min(F.when(F.col("_order") > k - F.col(f"{r}_under"), F.col("score"))).alias(r) for r, k in ranks.items()]
    cuts = totals.join(met.groupBy("feature").agg(*picks), "feature")
    for name, c in contamination.items():
        rank = F.lit(1.0 - c) * (F.col("_n") - 1)
        cuts = cuts.withColumn(f"{name}_cut", F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (rank - F.floor(rank)))
    cuts = cuts.select("feature", "most", *[f"{n}_{c}" for n in contamination for c in ("cut", "sure")])
    found = scored.join(cuts, "feature").groupBy("feature").agg(
        *[F.least(F.min(F.when(F.col("score") > F.col(f"{n}_cut"), F.col("size"))), F.first(f"{n}_sure")).alias(n) for n in contamination],
        F.first("most").alias("most"),
    )
    return found.select("feature", *[F.coalesce(n, "most").alias(n) for n in contamination])


def group_includes_normal(intervals: DataFrame, rules: CauseRules) -> DataFrame:
    """Groups with anomalies and whether normal operation bounds them; the last profile of a group decides."""
    order = F.lit(None).cast("int")
    include = F.lit(None).cast("boolean")
    for i, p in enumerate(rules.profiles):
        own = F.col("cause") == p.name.strip()
        order, include = F.when(own, F.lit(i)).otherwise(order), F.when(own, F.lit(p.include_normal)).otherwise(include)
    anomalies = map_groups(intervals.where((F.col("label") == "anomaly") & (F.col("cause") != "")), rules)
    decided = F.max_by(include, order)
    return anomalies.groupBy("cause_group").agg(
        F.min("row_id").alias("first_row"), F.coalesce(decided, F.lit(True)).alias("include_normal")
    )


def group_thresholds(
    features: DataFrame, intervals: DataFrame, pool_intervals: DataFrame, cfg: DetectSettings
) -> DataFrame:
    """``(cause_group, first_row, thr_delta, thr_slope, normal_delta, normal_slope)`` of every group with anomalies."""
    pool = pool_features(features, pool_intervals).where(F.col("feature").isin("pressure_delta", "pressure_slope"))
    cuts = tail_thresholds(pool, {"tight": cfg.contamination, "loose": cfg.normal_contamination})
    fitted = {r["feature"]: r for r in cuts.collect()}  # at most two rows
    groups = group_includes_normal(intervals, cfg.causes)

    def cut(feature: str, name: str):
        value = float(fitted[feature][name]) if feature in fitted else 0.0
        return F.when(F.col("include_normal"), F.lit(value)).otherwise(0.0)

    floor = F.lit(cfg.threshold_floor)
    delta = F.greatest(cut("pressure_delta", "tight"), floor)
    slope = F.greatest(cut("pressure_slope", "tight"), floor)
    for group, pinned in cfg.causes.pinned_slope.items():
        own = F.col("cause_group") == group
        slope = F.when(own, F.lit(float(pinned))).otherwise(slope)
        delta = F.when(own, F.greatest(delta, F.lit(0.01))).otherwise(delta)
    return groups.select(
        "cause_group",
        "first_row",
        delta.alias("thr_delta"),
        slope.alias("thr_slope"),
        cut("pressure_delta", "loose").alias("normal_delta"),
        cut("pressure_slope", "loose").alias("normal_slope"),
    )


def resolve_thresholds(wells: DataFrame, intervals: DataFrame, thresholds: DataFrame, rules: CauseRules) -> DataFrame:
    """Each well's cause, group and thresholds.

    A well without an anomaly takes the first group's name as its cause; a group without
    thresholds takes the first group's; with no thresholds at all the well is left out.
    """
    names = ("thr_delta", "thr_slope", "normal_delta", "normal_slope")
    first = thresholds.orderBy("first_row").first()  # the group whose anomaly comes first
    rows = wells.select("well").distinct().join(well_causes(intervals), "well", "left")
    rows = rows.withColumn("cause", F.coalesce("cause", F.lit(first["cause_group"] if first else None)))
    found = map_groups(rows, rules).join(thresholds.drop("first_row"), "cause_group", "left")
    return found.select(
        "well", "cause", "cause_group", *[F.coalesce(c, F.lit(first[c] if first else None)).alias(c) for c in names]
    ).where(F.col("thr_delta").isNotNull())


def well_rules(intervals: DataFrame, thresholds: DataFrame, cfg: DetectSettings) -> DataFrame:
    """One row per well with anomalies: its cause, families and effective (softened) thresholds."""
    resolved = resolve_thresholds(intervals.where(F.col("label") == "anomaly"), intervals, thresholds, cfg.causes)
    rows = resolved.withColumns(
        {
            "inflow": is_inflow("cause", cfg.causes),
            "leak": is_leak("cause", cfg.causes),
            "holdout": F.col("well").isin(list(cfg.holdout)) if cfg.holdout else F.lit(False),
        }
    )
    return rows.withColumns({c: soften(c, "inflow", cfg.causes.softening) for c in ("thr_delta", "thr_slope")})


__all__ = [
    "FEATURE_LIMITS",
    "group_includes_normal",
    "group_thresholds",
    "pool_features",
    "resolve_thresholds",
    "tail_thresholds",
    "well_rules",
]
