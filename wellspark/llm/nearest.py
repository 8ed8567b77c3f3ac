"""Nearest neighbours on randomly rotated one-bit codes.

A vector, less the centroid and scaled to length one, is rotated into ``bits`` dimensions by a fixed
random rotation (more than it has, which makes the estimate sharper) and stored as its signs: one bit
each, packed, with two scalars - its distance from the centroid and the product of the rotated
vector with its own sign vector. The product of a query with the sign vector over that scalar is an
unbiased estimate of the product with the vector itself, with an error of at most
``SURE * sqrt((1 - p^2) / p^2 / (bits - 1))`` but for rare cases. So every candidate has a lower and an
upper bound of its distance, and only those whose lower bound is not above the k-th smallest upper
bound are compared with the query on the original vectors, in double precision.

Queries and codes meet in blocks of bounded size; every query sees every code. Per block only
candidates that the block's bounds leave possible go on. Vectors that are null, zero or hold null
or non-finite components, or have another number of components than most, take no part; equal
distances are ranked by id; rows with an equal id are candidates each and one query together; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wellspark.llm.arrow import schema_of, slices
from wellspark.staging import stage

BITS = 512
SURE = 2.4
QUERY_BLOCK = 8192
CODE_BLOCK = 32768
_STEP = 2048
CODES = "row_id bigint, code binary, distance float, own float"


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def rotation(dims: int, bits: int, seed: int = 7) -> np.ndarray:
    """``bits`` x ``dims`` matrix with orthonormal columns."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dims)))[0]


def encode(vectors: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, distance from the centroid, and product of the rotated vector with its sign vector."""
    rest = vectors - centroid
    distance = np.sqrt((rest**2).sum(axis=1))
    unit = rest / np.where(distance > 0, distance, 1)[:, None]
    turned = unit @ turn.T
    own = np.where(distance > 0, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[0]), 1.0)
    return np.packbits(turned > 0, axis=1), distance, own


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _encode_batches(batches, centroid, turn):
    schema = schema_of(CODES)
    for batch in slices(batches, _STEP):
        codes, distance, own = encode(_matrix(batch.column(1), turn.shape[1]), centroid, turn)
        columns = [batch.column(0), pa.array([c.tobytes() for c in codes], type=pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(distance.astype(np.float32)), pa.array(own.astype(np.float32))], schema=schema)


FOUND = "query_id bigint, row_id bigint, low double, high double"


def _compare(queries: pa.Table, codes: pa.Table, centroid, turn, k: int, sure: float) -> pa.Table:
    """Candidates of one block of queries in one block of codes, with bounds of their distances."""
    schema = schema_of(FOUND)
    if not queries.num_rows or not codes.num_rows:
        return schema.empty_table()
    bits, dims = turn.shape
    query_id = queries.column("query_id").to_numpy()
    rest = _matrix(queries.column("vector").combine_chunks(), dims) - centroid
    length = np.sqrt((rest**2).sum(axis=1))
    turned = ((rest / np.where(length > 0, length, 1)[:, None]) @ turn.T / np.sqrt(bits)).astype(np.float32)
    row_id = codes.column("row_id").to_numpy()
    packed = np.frombuffer(b"".join(codes.column("code").to_pylist()), dtype=np.uint8).reshape(len(row_id), -1)
    signs = np.unpackbits(packed, axis=1, count=bits).astype(np.float32) * 2 - 1
    distance = codes.column("distance").to_numpy().astype(np.float64)
    own = codes.column("own").to_numpy().astype(np.float64)
    error = sure * np.sqrt(np.maximum(1 - own**2, 0) / own**2 / max(bits - 1, 1)) + 1e-6
    out = []
    step = max(1, (1 << 22) // len(row_id))
    for at in range(0, len(query_id), step):
        some = slice(at, at + step)
        product = (turned[some] @ signs.T) / own
        base = length[some, None] ** 2 + distance**2
        twice = 2 * length[some, None] * distance
        low, high = base - twice * (product + error), base - twice * (product - error)
        self_ = query_id[some, None] == row_id
        low[self_], high[self_] = np.inf, np.inf
        border = np.partition(high, min(k, len(row_id)) - 1, axis=1)[:, min(k, len(row_id)) - 1]
        q, c = np.nonzero((low <= border[:, None]) & ~self_)
        out.append((query_id[some][q], row_id[c], low[q, c], high[q, c]))
    return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bits: int = BITS,
    sure: float = SURE,
) -> DataFrame:
    """``(query_id, rank, row_id, score)``: the ``k`` nearest other rows of each row that ``queries`` selects."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("row_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asking"))
    most = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return spark.createDataFrame([], "query_id bigint, rank int, row_id bigint, score double")
    dims = most["dims"]
    rows = rows.where(F.size("vector") == dims)
    parts = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean")).collect()
    centroid = np.array([r["mean"] for r in sorted(parts, key=lambda r: r["at"])])
    turn = rotation(dims, max(bits, dims))
    query_blocks, code_blocks = -(-most["asking"] // QUERY_BLOCK) or 1, -(-most["n"] // CODE_BLOCK)
    codes = rows.select("row_id", "vector").mapInArrow(lambda b: _encode_batches(b, centroid, turn), CODES)
    codes = codes.withColumn("code_block", F.pmod(F.hash("row_id"), F.lit(code_blocks)))
    codes = codes.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = rows.where("asks").groupBy(F.col("row_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    placed = asked.withColumn("query_block", F.pmod(F.hash("query_id"), F.lit(query_blocks)))
    placed = placed.withColumn("code_block", F.explode(F.sequence(F.lit(0), F.lit(code_blocks - 1))))
    keys = ["query_block", "code_block"]
    met = placed.groupBy(*keys).cogroup(codes.groupBy(*keys))
    found = stage(met.applyInArrow(lambda q, c: _compare(q, c, centroid, turn, k, sure), FOUND), "bounds")
    by_high = Window.partitionBy("query_id").orderBy("high", "row_id")
    border = found.withColumn("n", F.row_number().over(by_high)).where(F.col("n") <= k).groupBy("query_id").agg(F.max("high").alias("border"), F.max("n").alias("n"))
    left = found.join(border, "query_id").where((F.col("low") <= F.col("border")) | (F.col("n") < k)).select("query_id", "row_id")
    pairs = left.distinct().join(rows.select("row_id", F.col("vector").alias("there")), "row_id").join(asked, "query_id")
    squares = F.zip_with("vector", "there", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    scored = pairs.select("query_id", "row_id", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)).alias("score"))
    nearest = Window.partitionBy("query_id").orderBy("score", "row_id")
    ranked = scored.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "row_id", "score")
