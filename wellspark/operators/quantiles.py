"""Exact interpolated quantiles of groups of any size.

The built-in exact percentile keeps a group's distinct values in one buffer. Here
values are binned on a fixed logarithmic scale and ranks are located from bin counts,
which are summed before they are exchanged; of the values themselves only those in a bin
that holds a wanted rank are exchanged and ordered. The input is read twice, so it should
be a written table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wellspark.staging import stage

_PER_E_FOLD = 2048
_OFFSET = 800 * _PER_E_FOLD  # ln of any positive double is above -746


def value_bin(v: Column) -> Column:
    """Integer that never decreases with ``v``: about 0.05 % of the value per step."""
    size = F.floor(F.log(F.abs(v)) * F.lit(float(_PER_E_FOLD))) + F.lit(_OFFSET)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("int")


def weighed(df: DataFrame, keys: Sequence[str], value: str, weight: str | None) -> DataFrame:
    """Usable values with their bin: ``(keys, _bin, _v, _c)``, one row per input row."""
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    count = (F.col(weight) if weight else F.lit(1)).cast("bigint")
    return rows.select(*keys, value_bin(v).alias("_bin"), v.alias("_v"), count.alias("_c"))


def bin_offsets(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per bin: rows in it, rows in lower bins, rows of the key: ``(keys, _bin, _in, _below, _n)``."""
    order = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.groupBy(*keys, "_bin")
        .agg(F.sum("_c").alias("_in"))
        .select(
            *keys,
            "_bin",
            "_in",
            (F.sum("_in").over(order) - F.col("_in")).alias("_below"),
            F.sum("_in").over(Window.partitionBy(*keys)).alias("_n"),
        )
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """``(keys, n, <name>…)``: linearly interpolated quantiles of the non-null values per key.

    ``weight`` repeats a row that many times. Keys without values are absent.
    """
    if not keys:
        tagged = df.withColumn("_all", F.lit(1))
        return exact_quantiles(tagged, ["_all"], value, probs, weight).drop("_all")
    values = weighed(df, keys, value, weight)

    def rank(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_n") - 1)

    def holds(r: Column, low: Column, high: Column) -> Column:
        return (r >= low) & (r < high)

    low, high = F.col("_below"), F.col("_below") + F.col("_in")
    wanted = F.lit(False)
    for p in probs.values():
        wanted = wanted | holds(F.floor(rank(p)), low, high) | holds(F.ceil(rank(p)), low, high)
    # The bins that hold a rank: a few rows per key, written so that their size decides the join.
    bins = stage(bin_offsets(values, keys).where(wanted), "ranks")
    near = values.join(bins, [*keys, "_bin"]).groupBy(*keys, "_bin", "_v", "_below", "_n").agg(F.sum("_c").alias("_c"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("_high", F.sum("_c").over(inside) + F.col("_below")).withColumn("_low", F.col("_high") - F.col("_c"))
    picks = [F.first("_n").alias("n")]
    for name, p in probs.items():
        for side, r in (("lo", F.floor(rank(p))), ("hi", F.ceil(rank(p)))):
            picks.append(F.max(F.when(holds(r, F.col("_low"), F.col("_high")), F.col("_v"))).alias(f"_{name}_{side}"))
    found = ranked.groupBy(*keys).agg(*picks)

    def interpolate(name: str, p: float) -> Column:
        r = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (lo + (hi - lo) * (r - F.floor(r))).alias(name)

    return found.select(*keys, "n", *[interpolate(name, p) for name, p in probs.items()])
