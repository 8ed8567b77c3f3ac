"""Subtree totals of a forest by parallel tree contraction.

Each round rakes and compresses. Rake: every leaf leaves the tree and its parent takes over what it
has gathered. Compress: in a chain of nodes with one child each, the nodes whose hash is above that of
both neighbours leave; the child is linked to the grandparent, over an edge that carries what was
bypassed. A round takes all leaves and about a third of the chain nodes, so a tree of any depth
is gone after a number of rounds that grows with the logarithm of its size. Each round is a written
table. A node raked has its total; a compressed node's total is what it had gathered, its edge, and the
total of the child that outlived it, which is looked up by pointer jumping from child to child.

Links must lead to roots (nodes whose parent is null) without cycles; an empty table has no totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.staging import stage


def _round(live: DataFrame, values: Sequence[str], turn: int) -> DataFrame:
    """Rakes the leaves of ``live (id, parent, leaf, acc, edge)``; adds how each node goes on: ``how`` is ``raked``,
    ``compressed`` or null, ``heir`` the only child left."""
    gone = F.col("leaf")
    heir = F.when(~gone, F.struct("id", "edge"))
    sums = [F.sum(F.when(gone, F.col(f"acc.{v}") + F.col(f"edge.{v}")).otherwise(0)).alias(v) for v in values]
    below = live.groupBy(F.col("parent").alias("up")).agg(
        F.struct(*sums).alias("raked"), F.count(heir).alias("n"), F.min(F.when(~gone, F.col("id"))).alias("heir"), F.min_by("edge", F.when(~gone, F.col("id"))).alias("heir_edge")
    )
    met = live.join(below, F.col("id") == F.col("up"), "left").drop("up")
    acc = F.struct(*[(F.col(f"acc.{v}") + F.coalesce(F.col(f"raked.{v}"), F.lit(0))).alias(v) for v in values])
    mark = lambda c: F.xxhash64(F.lit(turn), c)
    top = (mark(F.col("id")) > mark(F.col("parent"))) & (mark(F.col("id")) > mark(F.col("heir")))
    chain = (F.coalesce("n", F.lit(0)) == 1) & F.col("parent").isNotNull()
    how = F.when(F.col("leaf"), F.lit("raked")).when(chain & top, F.lit("compressed"))
    return met.select("id", "parent", acc.alias("acc"), "edge", (F.coalesce("n", F.lit(0)) == 0).alias("leaf"), "heir", "heir_edge", how.alias("how"))


def _next(now: DataFrame, values: Sequence[str]) -> DataFrame:
    """The nodes left after a round; children of compressed nodes move up."""
    left = now.where("how IS NULL").select("id", "parent", "leaf", "acc", "edge")
    gone = now.where("how = 'compressed'").select(F.col("id").alias("v"), F.col("parent").alias("up"), F.col("acc").alias("v_acc"), F.col("edge").alias("v_edge"))
    moved = F.col("v").isNotNull()
    edge = F.struct(*[F.when(moved, F.col(f"edge.{v}") + F.col(f"v_acc.{v}") + F.col(f"v_edge.{v}")).otherwise(F.col(f"edge.{v}")).alias(v) for v in values])
    joined = left.join(gone, F.col("parent") == F.col("v"), "left")
    return joined.select("id", F.when(moved, F.col("up")).otherwise(F.col("parent")).alias("parent"), "leaf", "acc", edge.alias("edge"))


def _sum(a: str, b: str, values: Sequence[str]) -> Column:
    return F.struct(*[(F.col(f"{a}.{v}") + F.col(f"{b}.{v}")).alias(v) for v in values])


def _expand(known: DataFrame, waiting: DataFrame, values: Sequence[str]) -> DataFrame:
    """``waiting (id, heir, acc)`` is owed its heir's total; heirs of heirs are jumped over until none waits."""
    while not waiting.isEmpty():
        done = known.select(F.col("id").alias("to"), "total")
        met = waiting.join(done, F.col("heir") == F.col("to"), "left")
        found = met.where("to IS NOT NULL").select("id", _sum("acc", "total", values).alias("total"))
        rest = met.where("to IS NULL").select("id", "heir", "acc")
        ahead = waiting.select(F.col("id").alias("to"), F.col("heir").alias("far"), F.col("acc").alias("more"))
        rest = rest.join(ahead, F.col("heir") == F.col("to")).select("id", F.col("far").alias("heir"), _sum("acc", "more", values).alias("acc"))
        known = known.unionByName(stage(found, "expanded"))
        waiting = stage(rest, "waiting")
    return known


def subtree_totals(nodes: DataFrame, values: Sequence[str], id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """``(id, <values>)``: each value summed over the node and all below it; values are whole numbers."""
    own = F.struct(*[F.col(v).cast("bigint").alias(v) for v in values])
    zero = F.struct(*[F.lit(0).cast("bigint").alias(v) for v in values])
    first = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), own.alias("acc"), zero.alias("edge"))
    parents = first.select(F.col("parent").alias("up")).where("up IS NOT NULL").distinct()
    live = first.join(parents, F.col("id") == F.col("up"), "left").select("id", "parent", F.col("up").isNull().alias("leaf"), "acc", "edge")
    rounds = []
    while True:
        now = stage(_round(live, values, len(rounds)), "contracted")
        rounds.append(now)
        live = _next(now, values)
        if not now.where("how IS NULL").limit(1).count():
            break
    every = reduce(DataFrame.unionByName, rounds)
    known = stage(every.where("how = 'raked'").select("id", F.col("acc").alias("total")), "raked")
    owed = every.where("how = 'compressed'").select("id", "heir", _sum("acc", "heir_edge", values).alias("acc"))
    known = _expand(known, stage(owed, "waiting"), values)
    return known.select("id", *[F.col(f"total.{v}").alias(v) for v in values])
