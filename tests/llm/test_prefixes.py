import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wellspark.llm import contraction, prefixes, queries

COLUMNS = "conv_id bigint, turn bigint, role string, text string, pos string, a string, depth string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def expected(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += children[node] == 0
        saved[node] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        if node:
            children[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    out = set()
    for node, some in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in some if len(convs[c]) == len(node)))
        up = min(members[node[:-1]]) if node else None
        out.add((min(some), len(node), up, len(some), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(seed, convs=260):
    rng = random.Random(seed)
    out = []
    for c in [None, *rng.sample(range(400), convs)]:
        for turn in [None, *range(rng.randint(0, 7))][rng.randint(0, 1) :]:
            out.append((c, turn, rng.choice(("user", "assistant", None)), rng.choice(("x", "yy", "", None, "é𝄞")), "p", "a", "d"))
    out.extend([(401, 5, "user", "again", "p", "a", "d")] * 3)
    out.extend((500, t, "user", f"deep {t % 3}", "p", "a", "d") for t in range(90))
    out.extend((600, t, "user", f"deep {t % 3}", "p", "a", "d") for t in range(60))
    return out


def trie(spark, rows, plain=True):
    turns = prefixes.numbered_turns(spark.createDataFrame(rows, COLUMNS).repartition(4))
    convs = prefixes.conversation_ids(turns)
    if not plain:
        c = F.col("conv_id")
        turns, convs = prefixes.branched(turns, convs, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5)
    return [tuple(r[n] for n in NAMES) for r in prefixes.prefix_trie(turns, convs).collect()]


@pytest.mark.parametrize("plain", [True, False])
def test_trie_equals_brute_force(spark, plain, monkeypatch):
    # Chunks of a few turns, so that a conversation is carried over many.
    monkeypatch.setattr(prefixes, "BLOCK_ROWS", 4)
    monkeypatch.setattr(prefixes, "block_of", lambda pos: F.floor((F.col(pos) - 1) / 4))
    monkeypatch.setattr(prefixes, "_SLICE", 3)
    rows = made(1 + plain)
    convs = sequences(rows)
    found = trie(spark, rows, plain)
    assert set(found) == expected(convs if plain else rebuilt(convs)) and len(found) == len(set(found))


def test_turnless_conversations(spark):
    # Conversation 103's two turns are replaced by those of conversation 100, which isn't there.
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(101, 200)}
    c = next(c for c in h if h[c] >= 2)
    rows = [(c, 0, "user", "x", "", "", ""), (c, 1, "user", "y", "", "", "")]
    assert trie(spark, rows, False) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = [tuple(r[n] for n in NAMES) for r in queries.QUERIES["op13_contracted_trie"](spark, sf_dir).collect()]
    assert set(found) == expected(rebuilt(sequences(rows))) and len(found) == len(set(found))


def test_nothing(spark):
    assert trie(spark, []) == [] and trie(spark, [], False) == []


def totals_of(parents, values):
    out = dict(values)
    for node in sorted(parents, reverse=True):  # parents have smaller numbers
        if parents[node] is not None:
            out[parents[node]] += out[node]
    return out


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest", "caterpillar"])
def test_subtree_totals(spark, shape):
    rng, n = random.Random(3), 300
    up = {
        "chain": lambda i: i - 1,
        "star": lambda i: 0,
        "random": lambda i: rng.randrange(i),
        "forest": lambda i: i - 1 if i % 50 else None,
        "caterpillar": lambda i: i - 1 if i % 2 else max(0, i - 2),
    }[shape]
    parents = {i: None if i == 0 else up(i) for i in range(n)}
    values = {i: rng.randint(-5, 9) for i in range(n)}
    rows = spark.createDataFrame([(i, p, values[i], 1) for i, p in parents.items()], "id int, parent int, v int, one int")
    found = {r["id"]: (r["v"], r["one"]) for r in contraction.subtree_totals(rows, ["v", "one"]).collect()}
    want, sizes = totals_of(parents, values), totals_of(parents, dict.fromkeys(parents, 1))
    assert found == {i: (want[i], sizes[i]) for i in parents}
