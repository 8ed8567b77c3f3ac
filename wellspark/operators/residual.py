"""Robust multivariate score of the z-scores, moving averages and spikes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wellspark.functions.scalar import floor_div
from wellspark.operators.baseline import median_and_spread, unpivot
from wellspark.operators.intervals import bucketed_coverage, weigh_points
from wellspark.operators.ordering import BLOCK_ROWS, number_rows
from wellspark.operators.quantiles import exact_quantiles, value_bin
from wellspark.schema import MODELLED, ResidualSettings
from wellspark.staging import stage

# fixed values: chi-square quantiles at 0.5 and 0.975 for 1, 2 and 3 dimensions
CHI2_MEDIAN = (0.454936423119573, 1.386294361119891, 2.365973884375338)
CHI2_975 = (5.023886187314888, 7.377758908227871, 9.348403604496148)


@dataclass(frozen=True)
class ResidualModel:
    metrics: tuple[str, ...]
    location: tuple[float, ...]
    precision: tuple[tuple[float, ...], ...]
    threshold: float


def squared_distance(columns: list[str], location, precision) -> Column:
    """Squared Mahalanobis distance as a column; null when any coordinate is."""
    away = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, location)]
    total = F.lit(0.0)
    for i, a in enumerate(away):
        for j, b in enumerate(away):
            total = total + a * b * F.lit(float(precision[i][j]))
    return total


_COARSE = 16  # bins of the quantile scale taken together: steps of 0.8 % of a distance
_PARTS, _FEW = 4096, 4096


class _Sums:
    """Weighted count, sums and sums of products of points relative to ``about``, a point among them, so that no
    digits are lost where they lie far from zero. Sums of parts add up."""

    def __init__(self, columns: list[str], about):
        self.columns, self.about = columns, np.array(about, dtype=float)
        self.pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]

    def aggregates(self, chosen: Column | None = None) -> list[Column]:
        w = F.col("weight") if chosen is None else F.when(chosen, F.col("weight")).otherwise(0)
        away = [F.col(c) - F.lit(float(m)) for c, m in zip(self.columns, self.about)]
        found = [w, *[w * x for x in away], *[w * away[i] * away[j] for i, j in self.pairs]]
        return [F.sum(c).cast("double").alias(f"s{k}") for k, c in enumerate(found)]

    def of_row(self, row) -> np.ndarray:
        return np.array([row[f"s{k}"] or 0.0 for k in range(1 + len(self.columns) + len(self.pairs))])

    def of_points(self, weight: np.ndarray, points: np.ndarray) -> np.ndarray:
        away = points - self.about
        return np.array([weight.sum(), *(weight[:, None] * away).sum(axis=0), *[(weight * away[:, i] * away[:, j]).sum() for i, j in self.pairs]])

    def moments(self, sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Count, mean and population covariance."""
        p, n = len(self.columns), sums[0]
        if not n:
            return 0, np.zeros(p), np.zeros((p, p))
        mean, cov = sums[1 : 1 + p] / n, np.zeros((p, p))
        for k, (i, j) in enumerate(self.pairs):
            cov[i, j] = cov[j, i] = sums[1 + p + k] / n - mean[i] * mean[j]
        return n, mean + self.about, cov


def _closest(points: DataFrame, columns: list[str], location, precision, h: float):
    """Moments of the ``h`` closest points, with all that are as far as the last of them.

    Distances are counted in bins of a fixed scale, with each bin's sums, in one aggregate; the bins below the one that
    holds the border are in for sure. That bin is looked into in ever smaller parts, until few points are left.
    """
    sums = _Sums(columns, location)
    rows = points.withColumn("_d", squared_distance(columns, location, precision))
    part, inside, missing = floor_div(value_bin(F.col("_d")), _COARSE), 0.0, h
    ends = [F.min("_d").alias("low"), F.max("_d").alias("high"), F.count("*").alias("n")]
    while True:
        # At most as many rows as the scale has bins, or a bin parts.
        found = sorted(rows.groupBy(part.alias("part")).agg(*sums.aggregates(), *ends).collect(), key=lambda r: r["part"])
        for r in found:
            own = sums.of_row(r)
            if own[0] > missing:
                break
            inside, missing = inside + own, missing - own[0]
        if missing <= 0:
            return sums.moments(inside)
        if r["low"] == r["high"]:
            return sums.moments(inside + own)
        rows = rows.where(F.col("_d").between(r["low"], r["high"]))
        if r["n"] <= _FEW:
            break
        part = F.floor((F.col("_d") - F.lit(r["low"])) / F.lit((r["high"] - r["low"]) / _PARTS))
    few = np.array([tuple(x) for x in rows.select("_d", "weight", *columns).collect()], dtype=float)
    few = few[np.argsort(few[:, 0], kind="stable")]
    border = few[min(np.searchsorted(np.cumsum(few[:, 1]), missing), len(few) - 1), 0]
    few = few[few[:, 0] <= border]
    return sums.moments(inside + sums.of_points(few[:, 1], few[:, 2:]))


def _cut(points: DataFrame, distance: Column, prob: float) -> float:
    found = exact_quantiles(points.withColumn("_d", distance), [], "_d", {"cut": prob}, "weight")
    return found.first()["cut"]


def _usable(cov: np.ndarray) -> bool:
    return bool(np.isfinite(cov).all()) and np.linalg.det(cov) > 1e-12


def normal_scores(features: DataFrame, normal: DataFrame) -> DataFrame:
    """z-scores inside the normal intervals with the number of intervals over each point."""
    columns = [f"{n}_z" for n in MODELLED.values()]
    return weigh_points(features.select("well", "ts", *columns), bucketed_coverage(normal)).select(*columns, "weight")


def fit_residual_model(
    features: DataFrame, normal: DataFrame, cfg: ResidualSettings = ResidualSettings()
) -> ResidualModel | None:
    """Minimum-covariance-determinant fit from a deterministic robust start.

    Concentration steps keep the ``h`` closest points and refit, until the determinant
    settles; then one consistency correction and one reweighting. The driver sees only
    sums by bins of distance and a few points at the border.
    """
    if not cfg.enabled:
        return None
    pool = stage(normal_scores(features, normal), "z-pool")
    names = list(MODELLED.values())
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(f"{n}_z").isNotNull()
    counts = pool.agg(
        *[F.sum(F.when(F.col(f"{n}_z").isNotNull(), F.col("weight"))).alias(n) for n in names],
        F.sum(F.when(whole, F.col("weight"))).alias("whole"),
    ).first()
    active = tuple(n for n in names if (counts[n] or 0) >= cfg.min_points)
    if not active:
        return None
    columns = [f"{n}_z" for n in active]
    points = pool.dropna(subset=columns)
    every = active == tuple(names)
    n = (counts["whole"] if every else points.agg(F.sum("weight")).first()[0]) or 0
    if n < cfg.min_points:
        return None
    p = len(columns)
    h = math.ceil(0.5 * (n + p + 1))

    start = median_and_spread(unpivot(points, ["weight"], columns), ["metric"], "value", "weight")
    start = {r["metric"]: (r["median"], r["spread"]) for r in start.collect()}  # one row per coordinate
    location = [start[c][0] for c in columns]
    scales = [start[c][1] * 1.4826 for c in columns]
    if min(scales) <= 0:
        return None
    precision = np.diag([1.0 / s**2 for s in scales])
    determinant = None
    for _ in range(max(1, cfg.max_steps)):
        _, location, cov = _closest(points, columns, location, precision, h)
        if not _usable(cov):
            return None
        precision = np.linalg.inv(cov)
        previous, determinant = determinant, np.linalg.det(cov)
        if previous is not None and abs(determinant - previous) <= 1e-12 * abs(previous):
            break
    distance = squared_distance(columns, location, precision)
    correction = _cut(points, distance, 0.5) / CHI2_MEDIAN[p - 1]
    sums = _Sums(columns, location)
    near = points.agg(*sums.aggregates(distance / F.lit(correction) < F.lit(CHI2_975[p - 1]))).first()
    kept, location, cov = sums.moments(sums.of_row(near))
    if not kept or not _usable(cov):
        return None
    precision = np.linalg.inv(cov)
    threshold = _cut(points, squared_distance(columns, location, precision), 1.0 - cfg.t2_alpha)
    return ResidualModel(
        active, tuple(float(v) for v in location), tuple(tuple(float(v) for v in r) for r in precision), float(threshold)
    )


def model_frame(spark, model: ResidualModel | None) -> DataFrame:
    """The fitted model as a one-row table."""
    schema = "metrics array<string>, location array<double>, precision array<array<double>>, threshold double"
    rows = [] if model is None else [(list(model.metrics), list(model.location), [list(r) for r in model.precision], model.threshold)]
    return spark.createDataFrame(rows, schema)


def t2_score(model: ResidualModel | None) -> Column:
    if model is None:
        return F.lit(None).cast("double")
    return squared_distance([f"{m}_z" for m in model.metrics], model.location, model.precision)


def spike_flag(model: ResidualModel | None, limit: float) -> Column:
    hit = F.lit(False)
    for m in model.metrics if model else ():
        hit = hit | F.coalesce(F.abs(F.col(f"{m}_z")) > F.lit(limit), F.lit(False))
    return hit


def ewma(rows: DataFrame, lam: float, keys=("well", "metric"), order: str = "pos", x: str = "value") -> DataFrame:
    """Adds the exponentially weighted mean of the non-null ``x`` of a key, started at its first value.

    Runs on blocks so long that the weight of everything before the previous block is
    below double precision: a running weighted sum inside the block plus one carried value.
    """
    if not 0 < lam <= 1:
        raise ValueError("the smoothing weight must be in (0, 1]")
    valid = rows.where(F.col(x).isNotNull())
    if lam == 1:
        return valid.withColumn("ewma", F.col(x))
    keep = 1.0 - lam
    length = max(2, math.ceil(53 * math.log(2) / -math.log(keep)))
    keys = list(keys)
    numbered = number_rows(valid, keys, [order], floor_div(order, BLOCK_ROWS), "_nth")
    at = F.col("_at").cast("double")
    share = F.when(F.col("_nth") == 1, F.col(x)).otherwise(F.col(x) * F.lit(lam))
    inside = Window.partitionBy(*keys, "_run").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    local = numbered.withColumns(
        {"_run": floor_div(F.col("_nth") - 1, length), "_at": F.pmod(F.col("_nth") - 1, F.lit(length))}
    ).withColumn("_local", F.sum(share * F.pow(F.lit(keep), -at)).over(inside) * F.pow(F.lit(keep), at))
    ends = local.where(F.col("_at") == length - 1).select(
        *keys, (F.col("_run") + 1).alias("_run"), F.col("_local").alias("_carried")
    )
    value = F.col("_local") + F.coalesce(F.pow(F.lit(keep), at + 1) * F.col("_carried"), F.lit(0.0))
    return local.join(ends, [*keys, "_run"], "left").withColumn("ewma", value).drop("_nth", "_run", "_at", "_local", "_carried")


def ewma_flags(features: DataFrame, model: ResidualModel | None, cfg: ResidualSettings) -> DataFrame | None:
    """Grid points where any active metric's moving average is beyond the limit: ``(well, pos)``."""
    if model is None:
        return None
    z = unpivot(features, ["well", "pos"], [f"{m}_z" for m in model.metrics])
    averaged = ewma(z, cfg.ewma_lambda)
    return averaged.where(F.abs("ewma") > F.lit(cfg.ewma_limit)).select("well", "pos").distinct()
