"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has one bit per hash bit of the text's word shingles: the majority. Two texts are
linked when their fingerprints differ in at most ``radius`` = 3 of 64 bits. Then one of the two
32-bit halves differs in at most half the radius, one bit. Every distinct fingerprint therefore
emits, per half, variants within that radius and meets its partners on a common variant: a half
with an odd number of set bits emits all variants with one bit flipped and itself, one with an
even number only itself - two halves that differ in one bit have different parities, so one of
them reaches the other. (Balls of half the radius over all 64 bits would be 2,081 variants a
fingerprint, since radius 3 has no middle; halves need 34 on average and lose no link.)

Rows meeting on a variant are verified over all 64 bits, in blocks of bounded size, and each
meeting keeps a spanning forest of its verified links instead of all pairs. Equal fingerprints
are one node from the start, so a group of exact copies of any size costs one row.

Null and empty texts have fingerprint zero and are linked like any other; fewer words than a
shingle count as one shingle; rows without an id belong to no group (component null); repeated
rows share a node; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.llm.arrow import batch_of, schema_of, slices, utf8
from wellspark.llm.components import components
from wellspark.staging import stage

RADIUS = 3
SEED = 42
_BLOCK = 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 hashes of a text's word shingles, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    last = min(shingle, len(words))
    hashed = xxhash.xxh64_digest
    digests = b"".join([hashed(joined[a : b - 1], SEED) for a, b in zip(starts, starts[last:])])
    bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(n, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n).tobytes(), "big")


def _fingerprints(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    schema = schema_of("row_id bigint, fp bigint")
    for batch in slices(batches):
        values = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1).to_pylist())], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], schema=schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(row_id, fp)``: the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(lambda b: _fingerprints(b, shingle), "row_id bigint, fp bigint")


def _ball(key: Column) -> Column:
    """The key with each of its half's 32 bits flipped."""
    flips = F.array(*[F.lit(1 << (bit + 1)) for bit in range(32)])
    return F.transform(flips, lambda flip: key.bitwiseXOR(flip))


def variants(fp: Column) -> Column:
    """Array of variant keys: a half's 32 bits above the half's number."""
    halves = []
    for number, half in enumerate((F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF)))):
        key = F.shiftleft(half, 1).bitwiseOR(F.lit(number))
        own = F.array(key)
        halves.append(F.when(F.bit_count(half) % 2 == 1, F.concat(own, _ball(key))).otherwise(own))
    return F.concat(*halves)


def _forest(nodes: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Links ``(n, 2)`` of a spanning forest over the members of one meeting that are within ``radius``.

    Grows one tree after the other: members not yet reached are compared with a block of reached ones.
    """
    links, rest = [], np.arange(1, len(nodes))
    front = np.array([0])
    while len(rest):
        some, front = front[:_BLOCK], front[_BLOCK:]
        near = np.bitwise_count(fps[some, None] ^ fps[None, rest]) <= radius
        reached = near.any(axis=0)
        if reached.any():
            links.append(np.stack([nodes[some[near[:, reached].argmax(axis=0)]], nodes[rest[reached]]], axis=1))
            front = np.append(front, rest[reached])
            rest = rest[~reached]
        if not len(front) and len(rest):
            front, rest = rest[:1], rest[1:]
    return np.concatenate(links) if links else np.empty((0, 2), dtype=np.int64)


def _meet(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(variant, node, fp)`` sorted by variant to verified links; the open meeting is carried over."""
    schema = schema_of("a bigint, b bigint")
    rest = None
    for batch in batches:
        key, node, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = fp.view(np.uint64)
        if rest is not None:
            key, node, fp = (np.concatenate(x) for x in zip(rest, (key, node, fp)))
        edges = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(key)]))
        rest = key[starts[-1] :], node[starts[-1] :], fp[starts[-1] :]
        links = _pairs(node, fp, starts[:-1], ends[:-1], radius)
        if len(links):
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], schema=schema)
    if rest is not None:
        links = _pairs(rest[1], rest[2], np.array([0]), np.array([len(rest[0])]), radius)
        if len(links):
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], schema=schema)


def _pairs(node, fp, starts, ends, radius) -> np.ndarray:
    size = ends - starts
    two = starts[size == 2]
    near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
    found = [np.stack([node[near], node[near + 1]], axis=1)]
    for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
        found.append(_forest(node[s:e], fp[s:e], radius))
    return np.concatenate(found)


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` that connect all nodes ``(node, fp)`` whose fingerprints are within ``radius``."""
    if radius > 3:
        raise ValueError("halves guarantee a common variant up to radius 3")
    emitted = nodes.select(F.explode(variants(F.col("fp"))).alias("variant"), "node", "fp")
    met = emitted.repartition("variant").sortWithinPartitions("variant")
    return met.mapInArrow(lambda b: _meet(b, radius), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS
) -> DataFrame:
    """``(row_id, fp, component_id)`` for every row: the smallest id that links lead to."""
    marked = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stage(marked.where("row_id IS NOT NULL").groupBy("fp").agg(F.min("row_id").alias("node")), "nodes")
    groups = components(fingerprint_links(nodes, radius))
    named = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return marked.join(named, "fp", "left").select(
        "row_id", "fp", F.when(F.col("row_id").isNotNull(), F.col("component")).alias("component_id")
    )
