import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import WITHOUT_ID, documents, nothing, rows, texts
from wellspark.llm import curriculum, nearest


def brute_targets(sizes, share=1.5, limit=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = (left - sum(target.values())) / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > limit * sizes[s]]
        if not full:
            target.update((s, level * weight[s]) for s in free)
            break
        for s in full:
            target[s] = limit * sizes[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10_000, "c": 5, None: 77, "é": 300, "Z": 1},
    {"a": 1, "b": 1, "c": 1, "d": 1},
    {"only": 50},
    {"a": 0, "b": 9},
])
def test_targets(spark, sizes):
    found = curriculum.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size bigint")).collect()
    want = brute_targets(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in found} == want
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix(spark):
    docs = documents(spark, [WITHOUT_ID, rows()[0]])
    found = curriculum.mix(docs).collect()
    size = defaultdict(int)
    for r in [*rows(), WITHOUT_ID, rows()[0]]:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    target = brute_targets(size)
    taken = defaultdict(int)
    assert len(found) == len(texts()) + 2
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"])
        assert all(0 <= c["position"] <= 1 for c in r["copies"])
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 1
    again = curriculum.mix(docs.repartition(2)).collect()
    key = lambda r: (str(r["row_id"]), r["size"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_schedule_is_in_training_order(spark):
    docs = documents(spark)
    mixed = sorted((r["row_id"] or 0, r["size"], r["place"], r["taken"], len(r["copies"])) for r in curriculum.mix(docs).collect())
    planned = curriculum.schedule(curriculum.mix(docs))
    places = [(r["position"] is None, r["position"] or 0.0, r["pass"] or 0) for r in planned.collect()]
    assert places == sorted(places) and sum(1 for p in places if not p[0]) == sum(m[-1] for m in mixed)
    found = curriculum.scheduled_documents(planned).collect()
    assert sorted((r["row_id"] or 0, r["size"], r["taken"]) for r in found) == sorted((m[0], m[1], m[3]) for m in mixed)
    assert curriculum.scheduled_documents(curriculum.schedule(curriculum.mix(nothing(spark)))).count() == 0


def test_training_order(spark):
    docs = documents(spark)
    mixed = {r["row_id"]: r for r in curriculum.mix(docs).collect()}
    ordered = curriculum.training_order(docs)
    assert ordered.columns == docs.columns
    copies = defaultdict(list)
    for r in ordered.collect():
        copies[r["doc_id"]].append(len((r["text"] or "").split()))
        assert r["key"] == "k" and r["n_chars"] == len(r["text"])
    for i, r in mixed.items():
        if i != 13:  # its text has separators that are no word borders here
            assert sorted(copies.get(i, [])) == sorted(c["words"] for c in r["copies"])
    assert curriculum.training_order(nothing(spark)).count() == 0


def test_position_inverts_the_schedule(spark):
    t = spark.range(101).select((F.col("id") / 100).alias("t"))
    for a, b in ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0)):
        back = t.select("t", curriculum.position(curriculum.due(F.col("t"), F.lit(a), F.lit(b)), F.lit(a), F.lit(b)).alias("p")).collect()
        assert max(abs(r["t"] - r["p"]) for r in back) < 1e-7


def brute_nearest(table, asks, k):
    out = {}
    for q, x in table:
        if asks(q):
            found = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in table if i != q)[:k]
            out[q] = [i for _, i in found]
    return out


def as_rows(table):
    return [(i, [float(v) for v in x]) for i, x in table]


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CODE_BLOCK", 150)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(2)
    table = [(i, x.astype(np.float32).astype(np.float64)) for i, x in enumerate(rng.standard_normal((600, 24)) + 3)]
    table += [(1000 + i, x) for i, x in table[:20]]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [1.0, None] * 12), (2004, [float("nan")] * 24), (2005, [float("inf")] + [1.0] * 23), (2006, [1.0] * 5), (None, [1.0] * 24)]
    df = spark.createDataFrame([*as_rows(table), *odd], "vec_id bigint, embedding array<float>").withColumn("code", F.lit(1))
    found = nearest.search(df, F.col("vec_id") % 20 == 0).collect()
    want = brute_nearest(table, lambda i: i % 20 == 0, 10)
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["row_id"])
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.97 * 10 * len(want)
    points = dict(table)
    for r in found:
        assert r["score"] == pytest.approx(np.sqrt(((points[r["query_id"]] - points[r["row_id"]]) ** 2).sum()), abs=1e-12)


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame(as_rows([(0, np.ones(4)), (20, np.arange(4.0)), (7, np.ones(4))]), "vec_id bigint, embedding array<float>")
    found = nearest.search(few, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["row_id"]) for r in found) == [(0, 1, 7), (0, 2, 20), (20, 1, 0), (20, 2, 7)]
    assert nearest.search(few.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_error_bound_holds():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 32))
    turn = nearest.rotation(32, 256)
    np.testing.assert_allclose(turn.T @ turn, np.eye(32), atol=1e-12)
    codes, distance, own = nearest.encode(x, np.zeros(32), turn)
    q = rng.standard_normal(32)
    q /= np.linalg.norm(q)
    signs = np.unpackbits(codes, axis=1, count=256) * 2.0 - 1
    estimate = signs @ (turn @ q) / 16 / own
    truth = x @ q / distance
    error = nearest.SURE * np.sqrt((1 - own**2) / own**2 / 255)
    assert (np.abs(estimate - truth) <= error).mean() > 0.95
