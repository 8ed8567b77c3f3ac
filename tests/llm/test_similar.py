import random
import re

import numpy as np

import corpus_pipeline
from tests.llm.data import SYLLABLES, WITHOUT_ID, documents, rows, texts, words
from tests.llm.test_duplicates import brute_groups
from wellspark.llm import similar

SF_DIR = "/root/testdata/sf0.001"


def brute_set(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))) if found else frozenset()


def brute_near(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def changed(base, changes, seed):
    rng = random.Random(seed)
    out = list(base)
    for at in rng.sample(range(len(out)), changes):
        out[at] = rng.choice(SYLLABLES) + str(seed)
    return " ".join(out)


def some_texts():
    found = dict(texts())
    at = 1000
    for seed in range(12):
        base = words(500 + seed, 200)
        for changes in range(0, 12):
            found[at] = changed(base, changes, at)
            at += 1
    return found


def test_stage_keeps_what_brute_force_keeps(spark):
    found = some_texts()
    more = [(i, t, "en", "s1", 1, "r", "s", "f", "k", "t") for i, t in found.items() if i >= 1000]
    docs = documents(spark, [*more, WITHOUT_ID, rows()[0]])
    sets = {i: brute_set(t) for i, t in found.items()}
    groups = brute_groups(sorted(sets), lambda a, b: brute_near(sets[a], sets[b]))
    assert 12 < len({g for i, g in groups.items() if i >= 1000}) < 100
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(groups.values()))
    assert ids.count(None) == 1


def test_chain_of_a_band(spark, monkeypatch):
    """Members that are near copies of a neighbour only are one group; apart from it they are not."""
    monkeypatch.setattr(similar, "HUB_ROUNDS", 1)
    text = words(77, 400)
    chain = {i: " ".join(text[i * 20 : i * 20 + 200]) for i in range(10)}
    chain[50] = " ".join(text[30:90] + words(78, 100))
    sets = {i: brute_set(t) for i, t in chain.items()}
    groups = brute_groups(sorted(sets), lambda a, b: brute_near(sets[a], sets[b]))
    assert groups[9] == 0 and groups[50] == 50
    found = similar.near_copies(spark.createDataFrame(list(chain.items()), "doc_id bigint, text string"))
    assert {r["row_id"]: r["component_id"] for r in found.collect()} == groups


def alike_texts(n):
    """Texts of one origin; two of them have a similarity of about 0.7, every tenth has a near copy."""
    base = words(901, 150)
    found = {i: changed(base, 5, 2000 + i) for i in range(n)}
    return found | {n + i: found[i] + " more" for i in range(0, n, 10)}


def test_texts_that_are_alike_are_not_written_as_pairs(spark, monkeypatch):
    """No step makes more rows than the members of all bands, and those grow with the texts only."""
    found, made = alike_texts(300), {}

    def counted(df, name, *more):
        out = staged(df, name, *more)
        made[name] = max(made.get(name, 0), out.count())
        return out

    staged = similar.stage
    monkeypatch.setattr(similar, "stage", counted)
    sets = {i: brute_set(t) for i, t in found.items()}
    groups = brute_groups(sorted(sets), lambda a, b: brute_near(sets[a], sets[b]))
    assert 100 < len(set(groups.values())) <= 300
    result = similar.near_copies(spark.createDataFrame(list(found.items()), "doc_id bigint, text string"))
    assert {r["row_id"]: r["component_id"] for r in result.collect()} == groups
    assert 1000 < made["members"] and max(made.values()) == made["members"], made


def test_chunks_of_a_band_meet(spark, monkeypatch):
    monkeypatch.setattr(similar, "HUB_ROUNDS", 0)
    monkeypatch.setattr(similar, "CHUNK_BYTES", 10 * similar._ROW_BYTES)
    found = alike_texts(60)
    sets = {i: brute_set(t) for i, t in found.items()}
    groups = brute_groups(sorted(sets), lambda a, b: brute_near(sets[a], sets[b]))
    result = similar.near_copies(spark.createDataFrame(list(found.items()), "doc_id bigint, text string"))
    assert {r["row_id"]: r["component_id"] for r in result.collect()} == groups


def test_one_id_for_several_texts(spark):
    a, b = " ".join(words(1, 50)), " ".join(words(2, 50))
    docs = spark.createDataFrame([(2, a), (5, a), (5, b), (5, b), (6, b), (None, a)], "doc_id bigint, text string").repartition(3)
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in similar.keep_one(docs).collect())
    assert kept == sorted([(2, a), (5, b), (0, a)])


def test_ball_hashing_finds_all_fingerprints_within_the_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), 1 << 63, 60)
    fps = [int(f) for f in base] + [int(f) ^ (1 << int(b)) for f in base for b in rng.integers(0, 63, 2)] + [int(base[0])]
    named = spark.createDataFrame(list(enumerate(fps)), "node bigint, fp bigint")
    near = {(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) & ((1 << 64) - 1)).bit_count() <= 3}
    group = {n: n for n in range(len(fps))}

    def top(n):
        return n if group[n] == n else top(group[n])

    for r in similar.ball_pairs(named).collect():
        assert (r["b"], r["a"]) in near
        group[top(r["b"])] = top(r["a"])
    assert all(top(a) == top(b) for a, b in near)


def test_fingerprint_of_a_set():
    text = " ".join(f"word{i}" for i in range(40_000))
    one, two, other = similar.shingle_sets([text, text + " more", " ".join(f"other{i}" for i in range(90))])
    assert similar.fingerprint(one[:0]) == 0
    distance = ((similar.fingerprint(one) ^ similar.fingerprint(two)) & ((1 << 64) - 1)).bit_count()
    assert distance <= 3 < ((similar.fingerprint(one) ^ similar.fingerprint(other)) & ((1 << 64) - 1)).bit_count()
