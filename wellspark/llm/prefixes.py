"""The trie of conversation prefixes: what conversations share, and what storing it once saves.

A node is a distinct sequence of first turns. Turns are numbered in chunks of their conversation and a
prefix is known by two running 64-bit hashes over its turns and their places, so neither a long
conversation nor a prefix that a third of all share is gathered in one task. A node is named by its depth
and its smallest member. Totals over subtrees come from ``contraction.subtree_totals``.

Turns are in the order of their number, null first, then of role and text; null roles and texts are empty
ones; rows without a conversation id are left out; repeated rows are turns of their own; conversations
without turns are members of the root only; an empty table has no nodes. Other columns are not read.
Two different prefixes are taken for one with a chance of about 2^-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wellspark.functions.scalar import floor_div
from wellspark.llm.arrow import schema_of
from wellspark.llm.contraction import subtree_totals
from wellspark.operators.ordering import BLOCK_ROWS, block_of, number_rows
from wellspark.staging import stage

_SLICE = 4096  # neighbouring ids joined into one text before digests are streamed
_FIRST = -(1 << 62)  # chunk of the turns without a number


def numbered_turns(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv_id, pos, turn_a, turn_b, chars)``: turns by their place from 1, as two hashes and a number of code points."""
    none = F.lit("")
    turns = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(role_col, none).alias("role"),
        F.coalesce(text_col, none).alias("text"),
    )
    chunk = F.coalesce(floor_div("turn", BLOCK_ROWS), F.lit(_FIRST))
    placed = number_rows(turns, ["conv_id"], ["turn", "role", "text"], chunk)
    hashes = [F.xxhash64(F.lit(seed), "role", "text").alias(f"turn_{x}") for x, seed in (("a", 1), ("b", 2))]
    return placed.select("conv_id", "pos", *hashes, F.length("text").cast("bigint").alias("chars"))


def conversation_ids(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)``."""
    return turns.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))


def branched(turns: DataFrame, convs: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: the first ``heads`` (at most ``most``) turns of conversation
    ``base``, then their own after as many. Gives their turns, and all of them with their number of turns."""
    wanted = convs.select("conv_id", "n_turns", base.alias("base"), heads.cast("bigint").alias("heads"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    # Few conversations are bases; only their first turns meet those that begin with them.
    plan = wanted.join(lengths, "base", "left")
    taken = F.least("heads", F.coalesce("base_turns", F.lit(0)))
    plan = stage(plan.select("conv_id", "n_turns", "base", "heads", taken.alias("taken")), "branches")
    bases = plan.select(F.col("base").alias("conv_id")).distinct()
    first = turns.where(F.col("pos") <= most).join(bases, "conv_id", "left_semi").withColumnRenamed("conv_id", "base")
    borrowed = plan.where("taken > 0").select("conv_id", "base", "taken").join(first, "base").where("pos <= taken")
    own = turns.join(plan.select("conv_id", "heads", "taken"), "conv_id").where("pos > heads")
    own = own.withColumn("pos", F.col("pos") - F.col("heads") + F.col("taken"))
    columns = ["conv_id", "pos", "turn_a", "turn_b", "chars"]
    total = F.col("taken") + F.greatest(F.col("n_turns") - F.col("heads"), F.lit(0))
    return borrowed.select(*columns).unionByName(own.select(*columns)), plan.select("conv_id", total.alias("n_turns"))


def prefix_members(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, a, b, up_a, up_b, chars)``: each conversation's nodes under the root, and their parents."""
    rows = turns.select(
        "conv_id",
        F.col("pos").alias("depth"),
        F.xxhash64("pos", "turn_a").alias("own_a"),
        F.xxhash64("pos", "turn_b").alias("own_b"),
        "chars",
        block_of("pos").alias("_block"),
    )
    inside = Window.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    run = [F.bit_xor(f"own_{x}").over(inside).alias(f"run_{x}") for x in "ab"]
    swept = rows.select("conv_id", "_block", "depth", "own_a", "own_b", "chars", *run)
    ends = rows.groupBy("conv_id", "_block").agg(*[F.bit_xor(f"own_{x}").alias(f"end_{x}") for x in "ab"])
    carried = [F.coalesce(F.bit_xor(f"end_{x}").over(across), F.lit(0)).alias(f"before_{x}") for x in "ab"]
    joined = swept.join(ends.select("conv_id", "_block", *carried), ["conv_id", "_block"])
    node = {x: F.col(f"run_{x}").bitwiseXOR(F.col(f"before_{x}")) for x in "ab"}
    up = [node[x].bitwiseXOR(F.col(f"own_{x}")).alias(f"up_{x}") for x in "ab"]
    return joined.select("conv_id", "depth", *[node[x].alias(x) for x in "ab"], *up, "chars")


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(depth, a, b, ids)`` sorted by node and id to one SHA-256 a node; the open node is carried over."""
    schema = schema_of("depth bigint, a bigint, b bigint, ends_sha256 string")
    key, state = None, None
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for depth, a, b, ids in zip(*columns):
            if (depth, a, b) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, state.hexdigest())))], schema=schema)


def _end_digests(ends: DataFrame) -> DataFrame:
    """Per node ``(depth, a, b)`` the digest of its conversations' ids, ascending, joined by commas.

    Ids are joined by slices first; a node's slices then pass through its digest one after the other."""
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    slices = ends.groupBy("depth", "a", "b", floor_div("conv_id", _SLICE).alias("slice")).agg(ids.alias("ids"))
    sorted_ = slices.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "slice")
    return sorted_.select("depth", "a", "b", "ids").mapInArrow(_digests, "depth bigint, a bigint, b bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    ``turns`` as of :func:`numbered_turns`; ``convs (conv_id, n_turns)`` names all conversations.
    """
    members = stage(prefix_members(turns), "prefixes")
    zero = F.lit(0).cast("bigint")
    grouped = members.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.any_value("up_a").alias("up_a"), F.any_value("up_b").alias("up_b"), F.any_value("chars").alias("chars")
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", zero.alias("up_a"), zero.alias("up_b"), zero.alias("chars"))
    nodes = stage(grouped.unionByName(root), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    name = F.struct("conv_id", "depth")
    parent = F.when(F.col("parent_conv_id").isNotNull(), F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))
    linked = nodes.join(above, ["depth", "up_a", "up_b"], "left").select("depth", "a", "b", "conv_id", "n_convs", "chars", "parent_conv_id", name.alias("id"), parent.alias("parent"))
    linked = stage(linked, "linked")
    children = linked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    counted = linked.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", zero))
    counted = counted.withColumns({"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    counted = stage(counted, "counted")
    totals = subtree_totals(counted, ["n_leaves", "saved_tokens"])
    last = members.join(convs, "conv_id").where("depth = n_turns").select("conv_id", "depth", "a", "b")
    last = last.unionByName(convs.where("n_turns = 0").select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b")))
    kept = counted.drop("n_leaves", "saved_tokens", "parent").join(totals, "id").join(_end_digests(last), ["depth", "a", "b"], "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return kept.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))
