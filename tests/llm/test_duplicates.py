import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import WITHOUT_ID, documents, nothing, rows, texts, words
from wellspark.llm import simhash, substrings
from wellspark.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = [w.lower() for w in WORD.findall((text or "").encode())]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark):
    docs = documents(spark, [WITHOUT_ID, rows()[0]])
    found = simhash.near_duplicates(docs).collect()
    fps = {i: brute_fingerprint(t) for i, t in texts().items()}
    groups = brute_groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert len(found) == len(fps) + 2
    for r in found:
        if r["row_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["fp"] % (1 << 64) == fps[r["row_id"]] and r["component_id"] == groups[r["row_id"]]
    assert groups[1] == groups[2] == groups[3] == 1 and groups[4] == 0


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(nothing(spark)).count() == 0


def test_links_on_close_fingerprints(spark):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    for f in list(fps):
        for flips in (1, 2, 3, 4):
            fps.append(f ^ sum(1 << int(b) for b in rng.choice(64, flips, replace=False)))
    fps = sorted(set(fps))
    groups = brute_groups(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    signed = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "node bigint, fp bigint"))
    for r in links.collect():
        assert (fps[r["a"]] ^ fps[r["b"]]).bit_count() <= 3
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert {i: found.get(i, i) for i in groups} == groups


def test_hot_ball_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 4)
    fps = np.arange(40, dtype=np.uint64)
    links = simhash._forest(np.arange(40), fps, 3)
    groups = brute_groups(range(40), lambda a, b: (a ^ b).bit_count() <= 3)
    pairs = {tuple(x) for x in links.tolist()}
    again = brute_groups(range(40), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert again == groups and len(links) == 39


def test_components_of_chain_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(50)]
    star = [(100, i) for i in range(101, 160)]
    rows_ = spark.createDataFrame([*chain, *star, *star, (7, 7), (300, 300)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components(rows_).collect()}
    assert found == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}}
    assert components(rows_.where("a < 0")).count() == 0


def brute_repeats(found, min_words=13):
    words = {i: WORD.findall((t or "").encode()) for i, t in found.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - min_words + 1):
            first.setdefault(tuple(words[i][k : k + min_words]), i)
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - min_words + 1):
            if first[tuple(w[k : k + min_words])] < i:
                keep[k : k + min_words] = [False] * min_words
        out[i] = (len(w), keep.count(False), b" ".join(x for x, y in zip(w, keep) if y).decode())
    return out


def test_repeats(spark):
    docs = documents(spark, [WITHOUT_ID, rows()[0]])
    want = brute_repeats(texts())
    found = substrings.remove_repeats(docs).collect()
    assert len(found) == len(want) + 2
    for r in found:
        if r["row_id"] is None:
            assert r["n_removed"] == 0 and r["n_words"] == 45
        else:
            assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["row_id"]]
    assert want[7][1] == 60 and want[4][2] == ""
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns
    by_id = {r["doc_id"]: r for r in cut.collect()}
    assert by_id[7]["text"] == want[7][2] and by_id[7]["n_chars"] == len(want[7][2]) and by_id[7]["row"] == "r"
    assert by_id[1]["text"] is None and by_id[3]["text"] == texts()[3]


def test_repeats_with_one_id_for_several_texts(spark):
    shared, own = words(900, 40), words(901, 30)
    found = [(1, shared), (5, [*own, *shared]), (5, words(902, 3)), (5, own), (6, own), (5, own), (7, None), (7, shared[:20])]
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in found], "doc_id bigint, text string").repartition(3)
    got = sorted((r["row_id"], r["kept"]) for r in substrings.remove_repeats(docs).collect())
    want = [(1, shared), (5, own), (5, words(902, 3)), (5, own), (5, own), (6, []), (7, []), (7, [])]
    assert got == sorted((i, " ".join(w)) for i, w in want)


def test_repeats_exchange_each_text_once(spark):
    docs = documents(spark, [WITHOUT_ID, rows()[0]])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = substrings.without_repeats(docs)
        cut.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    final = cut._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len([line for line in final.splitlines() if "ReusedExchange" in line and "body" in line]) == 1


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(nothing(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_a_small_vocabulary(spark, seed):
    rng = np.random.default_rng(seed)
    found = {i: " ".join(rng.choice(list("abc"), rng.integers(0, 60))) for i in range(60)}
    docs = spark.createDataFrame(list(found.items()), "doc_id bigint, text string").repartition(7)
    got = {r["row_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(docs, min_words=4, anchor_words=2).collect()}
    assert got == brute_repeats(found, 4)


def test_extension_across_batches():
    """The sorted stream gives the same rows however it is cut into batches."""
    import pyarrow as pa

    from wellspark.llm.arrow import schema_of

    rng = np.random.default_rng(1)
    table = sorted((int(k), int(e), int(d)) for k, e, d in rng.integers(0, 4, (300, 3)))
    columns = list(zip(*[(k, e, d, -d, (n << 30) | 1) for n, (k, e, d) in enumerate(table)]))
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema_of(substrings._ROW))

    def result(step):
        batches = [whole.slice(a, step) for a in range(0, whole.num_rows, step)]
        return sorted(tuple(r.values()) for b in substrings._extend(batches) for r in b.to_pylist())

    assert result(1) == result(7) == result(300)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\xa0é", max_size=30), max_size=6))
def test_word_hashes(found):
    from wellspark.llm.wordhash import word_hashes

    data = [t.encode() for t in found]
    hashes, first = word_hashes(data)
    known = {}
    for i, t in enumerate(data):
        own = WORD.findall(t)
        assert first[i + 1] - first[i] == len(own)
        for w, h in zip(own, hashes[first[i] : first[i + 1]].tolist()):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
