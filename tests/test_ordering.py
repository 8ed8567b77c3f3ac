"""Chunked operators give the same rows as one window per key, and as pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wellspark.operators import ordering
from wellspark.operators.quantiles import exact_quantiles, value_bin
from wellspark.operators.residual import ewma
from wellspark.schema import DAY, MINUTE


def series(n=400, seed=1, wells=2):
    rng = np.random.default_rng(seed)
    parts = []
    for w in range(wells):
        minutes = np.cumsum(rng.integers(1, 400, n))
        x = rng.normal(0, 5, n)
        x[rng.random(n) < 0.4] = np.nan
        parts.append(pd.DataFrame({"well": f"w{w}", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes, "min"), "x": x}))
    return pd.concat(parts, ignore_index=True)


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.select("well", F.col("ts").cast("timestamp_ntz").alias("ts"), F.when(~F.isnan("x"), F.col("x")).alias("x"))


def as_pandas(df, *order):
    return df.orderBy(*order).toPandas()


def test_positions_and_neighbours(spark):
    pdf = series()
    df = ordering.positions(frame(spark, pdf), ["well"], "ts", DAY)
    got = as_pandas(df, "well", "ts")
    assert got["pos"].tolist() == [*range(1, 401)] * 2

    chunked = df.withColumn("_c", ordering.block_of("pos", 7))
    near = as_pandas(ordering.neighbours(chunked, ["well"], "_c", ["pos"], ["x"]), "well", "ts")
    grouped = pdf.groupby("well")["x"]
    np.testing.assert_allclose(near["x_prev"].astype(float), grouped.ffill())
    np.testing.assert_allclose(near["x_next"].astype(float), grouped.bfill())


def test_forward_fill_is_unbounded(spark):
    rows = [("a", i, "v" if i == 0 else None, str(i) if i % 50 == 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "source_id string, row_id long, well string, cause string")
    got = ordering.forward_fill(df, ["source_id"], "row_id", ["well", "cause"], chunk_rows=16).orderBy("row_id").collect()
    assert all(r.well == "v" for r in got)
    assert [r.cause for r in got] == [None] * 3 + ["3"] * 50 + ["53"] * 50 + ["103"] * 50 + ["153"] * 47


def test_halo_frames_equal_whole_windows(spark):
    df = ordering.positions(frame(spark, series()), ["well"], "ts", DAY)
    blocks = ordering.with_halo(df, back=5, ahead=3, rows=16)
    per_block = Window.partitionBy("well", "_block").orderBy("pos").rowsBetween(-5, 3)
    whole = Window.partitionBy("well").orderBy("pos").rowsBetween(-5, 3)
    got = ordering.own_rows(blocks.withColumn("m", F.avg("x").over(per_block)), rows=16).select("well", "pos", "m")
    want = df.withColumn("m", F.avg("x").over(whole)).select("well", "pos", "m")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_sampling_gaps(spark):
    df = frame(spark, series())
    parts = [ordering.sampling_gaps(df, ["well"], "ts", days * DAY) for days in (2, 10_000)]
    assert parts[0].count() == 798
    assert parts[0].exceptAll(parts[1]).isEmpty() and parts[1].exceptAll(parts[0]).isEmpty()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {
            "k": rng.integers(0, 4, 3000),
            "v": np.round(np.concatenate([rng.normal(0, 1, 1000), rng.exponential(1e6, 1000), rng.normal(0, 1e-9, 1000)]), 12),
            "w": rng.integers(1, 4, 3000),
        }
    )
    pdf.loc[::50, "v"] = 0.0
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.937, "e": 1.0}
    df = spark.createDataFrame(pdf)
    for weight in (None, "w"):
        got = exact_quantiles(df, ["k"], "v", probs, weight).orderBy("k").toPandas()
        for _, row in got.iterrows():
            own = pdf[pdf.k == row.k]
            values = np.repeat(own.v, own.w) if weight else own.v
            assert row.n == len(values)
            np.testing.assert_allclose([row[p] for p in probs], np.quantile(values, list(probs.values())), rtol=1e-9, atol=1e-15)


def test_quantiles_of_one_hot_key_and_missing_values(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id") * 1.0).alias("v"))
    df = df.unionByName(spark.createDataFrame([("none", None), ("nan", float("nan"))], "k string, v double"))
    rows = exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()
    assert [(r.k, r.n, r.m) for r in rows] == [("hot", 2500, 2499.0)]


def test_value_bin_never_decreases(spark):
    values = sorted([0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, *np.random.default_rng(0).normal(0, 10, 500).tolist()])
    bins = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(value_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize("lam", [0.2, 0.7, 0.02, 1.0])
def test_ewma(spark, lam):
    pdf = series(n=900)
    df = ordering.positions(frame(spark, pdf), ["well"], "ts", DAY).withColumn("metric", F.lit("m"))
    got = as_pandas(ewma(df, lam, x="x"), "well", "pos")
    want = pdf.dropna().groupby("well")["x"].transform(lambda s: s.ewm(alpha=lam, adjust=False).mean())
    np.testing.assert_allclose(got["ewma"], want, rtol=1e-9, atol=1e-12)
    with pytest.raises(ValueError):
        ewma(df, 0.0)


def test_minute_constant():
    assert DAY == 24 * 60 * MINUTE and math.isclose(DAY, 86_400e6)
