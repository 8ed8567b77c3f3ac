"""Near copies by the Jaccard similarity of their word shingles.

Two texts are near copies when the sets of their five-word shingles (ASCII lower case) have a Jaccard
similarity of at least 0.8. Every link is verified on the whole sets; only its candidates are found by
hashing, in two steps. SimHash fingerprints of the sets meet by ball hashing first (``simhash``): those within
3 of 64 bits are candidates, and what verifies makes the first groups. Fingerprints at a similarity of 0.8
differ in about 10 bits, so most links there are beyond any ball that halves can guarantee. Candidates for
these are rows that agree on all five minima of one of 32 bands and are still in different groups. A pair at
similarity s has no common band with a chance of ``(1 - s^5)^32``: 3e-6 at 0.8, less above.

Rows of one band meet. Two rounds verify the rows of each band against one of them, so a band with
very many members costs one pair a member. What those rounds left in different groups is compared
inside each band by all 160 minima, and every pair that agrees on at least 0.6 of them (a pair at 0.8
agrees on fewer with a chance of about 1e-9) is verified too. That happens where the rows meet, with their
whole sets at hand: texts that are alike but under 0.8 are compared, never written as pairs, and a meeting
gives at most one link less than it has rows. A band's rows are dealt into chunks of about 4 MB of sets and
every two chunks meet in a cell of their own, so large bands spread over tasks of bounded memory. Verified
pairs do not depend on the order of rounds, since only pairs inside one group, which cannot change the
groups, are left out.

Equal sets are one node from the start, so a group of exact copies of any size costs one row. Fewer
words than a shingle count as one shingle; null and empty texts have the empty set and are copies of
each other; rows without an id belong to no group; rows of one id with different texts are different
documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm import simhash
from wellspark.llm.arrow import schema_of, slices, utf8
from wellspark.llm.components import components
from wellspark.llm.wordhash import mix, runs_of, word_hashes
from wellspark.staging import stage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
ALIKE = 0.6
HUB_ROUNDS = 2
# Bytes of sets in a chunk of a band; no row counts for less than the least, so a chunk has about 512 rows at most.
CHUNK_BYTES = 4 << 20
_ROW_BYTES = 8 << 10
_COLUMNS = 512
_PRINTED = 16_384
_random = np.random.default_rng(42)
_FLIP = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
_TIMES = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_SKETCH = "row_id bigint, twin bigint, node bigint, fp bigint, bands array<bigint>, minima binary"
_NUMBER = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C13)


def shingle_sets(texts: Iterable[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    hashes, first = word_hashes([t.lower() for t in utf8(texts)])
    words = [hashes[a:b] for a, b in zip(first.tolist(), first[1:].tolist())]
    return [np.unique(runs_of(w, min(shingle, len(w)))) if len(w) else w for w in words]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; that of two empty ones is 1."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def digest(hashes: np.ndarray) -> int:
    total = mix(hashes).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes))
    return int(mix(total).view(np.int64)[0])


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of the set: the bits that more than half of its hashes have."""
    up = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _PRINTED):
        some = mix(hashes[at : at + _PRINTED]).view(np.uint8).reshape(-1, 8)
        up += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * up > len(hashes)).view(np.int64)[0])


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _COLUMNS):
        np.minimum(least, ((hashes[None, at : at + _COLUMNS] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    total = _NUMBER.copy()
    for column in least.reshape(BANDS, ROWS).T:
        total = mix(total ^ column)
    return total.view(np.int64)


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = schema_of(_SKETCH)
    for batch in slices(batches):
        sets = shingle_sets(batch.column(2).to_pylist())
        least = [minima(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([digest(s) for s in sets], type=pa.int64()),
                pa.array([fingerprint(s) for s in sets], type=pa.int64()),
                pa.array([bands(v) for v in least], type=pa.list_(pa.int64())),
                pa.array([(v >> np.uint64(48)).astype(np.uint8).tobytes() for v in least], type=pa.binary()),
            ],
            schema=schema,
        )


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = schema_of("node bigint, hashes binary")
    for batch in slices(batches):
        sets = shingle_sets(batch.column(0).to_pylist())
        columns = [[digest(s) for s in sets], [s.tobytes() for s in sets]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], type=pa.int64()), pa.array(columns[1], type=pa.binary())], schema=schema)


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = schema_of("a bigint, b bigint")
    for batch in slices(batches):
        left, right = ([np.frombuffer(x, dtype=np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
        near = pa.array([jaccard(x, y) >= SIMILARITY for x, y in zip(left, right)], type=pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], schema=schema)


def _whole_sets(used: DataFrame, named: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, hashes)`` of the nodes in ``used``."""
    wanted = stage(named.join(used, "node").select("row_id"), "wanted")
    found = docs.join(wanted, "row_id", "left_semi").select("body").mapInArrow(_sets, "node bigint, hashes binary")
    return stage(found.dropDuplicates(["node"]).join(used, "node", "left_semi"), "sets")


def _verify(pairs: DataFrame, named: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose whole sets are similar."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _whole_sets(used, named, docs)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b"
    )
    return stage(both.select("a", "b", "left", "right").mapInArrow(_verified, "a bigint, b bigint"), "verified")


def _links(low: np.ndarray, node: np.ndarray, group: np.ndarray, least: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of similar sets in different groups that connect all such rows of one cell.

    Rows of the low chunk meet those of the high one; in a cell of one chunk all rows meet each other.
    """
    links, group = [], group.copy()
    left, right = np.flatnonzero(low), np.flatnonzero(~low)
    size = np.array([len(x) for x in sets])
    start = np.concatenate(([0], np.cumsum(size)))
    named = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = np.zeros(start[-1] + 1, dtype=np.uint8)
    for x in left.tolist():
        others = right if len(right) else left[left > x]
        others = others[(group[others] != group[x]) & (size[others] > 0)]
        alike = (least[others] == least[x]).sum(axis=1, dtype=np.int64) >= ALIKE * BANDS * ROWS
        others = others[alike]
        if not len(others):
            continue
        own = named[start[x] : start[x + 1]]
        held[own] = 1
        met = held[np.concatenate([named[start[y] : start[y + 1]] for y in others.tolist()])]
        held[own] = 0
        common = np.add.reduceat(met, np.cumsum(size[others]) - size[others], dtype=np.int64)
        near = others[common / (size[x] + size[others] - common) >= SIMILARITY]
        joined, at = np.unique(group[near], return_index=True)
        links += [(int(node[x]), int(node[y])) for y in near[at]]
        group[np.isin(group, joined)] = group[x]
    return links


def _left_apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(band, first, second, low, node, group, minima, hashes)`` sorted by their cell, the first three, to links; the open cell is carried over."""
    schema = schema_of("a bigint, b bigint")

    def linked(table):
        low, node, group = (table.column(i).to_numpy() for i in (3, 4, 5))
        least = np.frombuffer(b"".join(table.column(6).to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)
        links = _links(low.astype(bool), node, group, least, [np.frombuffer(x, dtype=np.uint64) for x in table.column(7).to_pylist()])
        columns = [pa.array([pair[i] for pair in links], type=pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.stack([batch.column(i).to_numpy() for i in range(3)])
        borders = (np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1).tolist()
        if last is not None and (cell[:, 0] != last).any():
            yield linked(pa.Table.from_batches(rest))
            rest = []
        for a, b in zip([0, *borders], borders):
            yield linked(pa.Table.from_batches([*rest, batch.slice(a, b - a)]))
            rest = []
        rest.append(batch.slice(borders[-1] if borders else 0))
        last = cell[:, -1]
    if rest:
        yield linked(pa.Table.from_batches(rest))


def ball_pairs(named: DataFrame) -> DataFrame:
    """Candidates ``(a, b)`` among ``(node, fp)``: sets of one fingerprint, and a spanning forest of fingerprints within a ball."""
    prints = stage(named.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    same = named.select("fp", F.col("node").alias("b")).join(prints, "fp").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b")
    met = simhash.fingerprint_links(prints).union(same)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the group that the links put each into."""
    found = stage(components(links), "groups")
    return nodes.join(found, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")


def _compared(groups: DataFrame, sketches: DataFrame, named: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between the rows of a band that are still in different groups: every two of them are compared."""
    ends = groups.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    apart = stage(groups.join(ends.select("band"), "band").select("band", "node", "group"), "apart")
    used = apart.select("node").distinct()
    least = sketches.select("node", "minima").join(used, "node", "left_semi").dropDuplicates(["node"])
    weight = F.greatest(F.octet_length("hashes").cast("bigint"), F.lit(_ROW_BYTES))
    sets = stage(_whole_sets(used, named, docs).join(least, "node").withColumn("weight", weight), "compared")
    sums = apart.join(sets.select("node", "weight"), "node").groupBy("band").agg(F.ceil(F.sum("weight") / CHUNK_BYTES).alias("chunks"))
    dealt = apart.join(sums, "band").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    chunks = [F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second")]
    cells = cells.select("band", *chunks, (F.col("chunk") <= F.col("other")).cast("int").alias("low"), "node", "group")
    met = cells.join(sets.select("node", "minima", "hashes"), "node")
    met = met.select("band", "first", "second", "low", "node", "group", "minima", "hashes")
    met = met.repartition("band", "first", "second").sortWithinPartitions("band", "first", "second")
    return stage(met.mapInArrow(_left_apart, "a bigint, b bigint"), "verified")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row_id, twin, component_id, component_twin)`` for every row with an id: the smallest row that links lead to.
    A row is named by its id and ``twin``, a hash of its text."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.xxhash64(text).alias("twin"), text.alias("body"))
    rows = rows.where("row_id IS NOT NULL")
    sketches = stage(rows.mapInArrow(_sketch, _SKETCH), "sketches")
    named = sketches.groupBy("node").agg(F.min(F.struct("row_id", "twin")).alias("own"), F.min("fp").alias("fp"))
    named = stage(named.select("node", "own", "own.row_id", "fp"), "nodes")
    first = sketches.join(named, ["node", "row_id"], "left_semi").select("node", F.explode("bands").alias("band"))
    met = first.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = stage(first.join(met.select("band"), "band").select("band", "node").distinct(), "members")
    links = _verify(stage(ball_pairs(named), "pairs"), named, rows)
    groups = stage(_grouped(members, links), "grouped")
    for turn in range(HUB_ROUNDS):
        rank = F.struct(F.xxhash64("node", F.lit(turn)), "node", "group")
        hubs = groups.groupBy("band").agg(F.min(rank).alias("hub"))
        apart = groups.join(hubs, "band").where(F.col("hub.group") != F.col("group"))
        pairs = apart.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        links = links.union(_verify(stage(pairs, "pairs"), named, rows))
        groups = stage(_grouped(members, links), "grouped")
    links = links.union(_compared(groups, sketches, named, rows))
    named = stage(_grouped(named, links), "named")
    names = named.groupBy("group").agg(F.min("own").alias("least"))
    named = stage(named.join(names, "group").select("node", "least"), "components")
    own = [F.col("least.row_id").alias("component_id"), F.col("least.twin").alias("component_twin")]
    return sketches.select("row_id", "twin", "node").join(named, "node").select("row_id", "twin", *own)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their group: the smallest of each, once; rows without an id stay."""
    found = near_copies(docs, id_col, text_col)
    named = (F.col("row_id") == F.col("component_id")) & (F.col("twin") == F.col("component_twin"))
    key = [id_col, "_twin"]
    marked = docs.withColumn("_twin", F.xxhash64(text_col))
    others = stage(found.where(~named).select(F.col("row_id").alias(id_col), F.col("twin").alias("_twin")).distinct(), "others")
    kept = marked.join(others, key, "left_anti")
    again = marked.where(F.col(id_col).isNotNull()).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    again = stage(again, "repeated")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(again, key, "left_semi").dropDuplicates(key)
    return kept.join(again, key, "left_anti").unionByName(once).select(*docs.columns)
