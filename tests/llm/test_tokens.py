import math
import zlib

import numpy as np
import pytest

from tests.llm.data import WITHOUT_ID, documents, nothing, rows, texts
from wellspark.llm import packing, records
from wellspark.llm.tokens import encoder


def library_ids(text):
    return encoder()._library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    odd = ["It's 'tis ²½ a_b IDIOT!!", "don't'll '''s", "ªº µ ß ǅ ÷×¬©®°", "é", "a b", "İstanbul ΣΑΣ", "\x85x", "  "]
    samples = [*texts().values(), *odd]
    assert [x.tolist() for x in encoder().encode(samples)] == [library_ids(t) for t in samples]


def test_shards_round_trip(spark, tmp_path):
    docs = documents(spark, [WITHOUT_ID, rows()[0]])
    index = records.write_shards(docs, folder=str(tmp_path), max_bytes=2_000)
    found = records.read_shards(index).join(records.shard_starts(index), "shard").collect()
    assert index.select("shard").distinct().count() > 3
    position = 0
    order = sorted(found, key=lambda r: r["base"] + r["before"])
    keys = [r["row_id"] for r in order]
    assert keys == [None, *sorted([*texts(), 0])]
    for r in order:
        text = WITHOUT_ID[1] if r["row_id"] is None else texts()[r["row_id"]]
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert ids == [*library_ids(text), 1] and r["n_tokens"] == len(ids)
        assert r["base"] + r["before"] == position
        position += len(ids)


def test_shards_of_nothing(spark):
    index = records.write_shards(nothing(spark))
    assert records.read_shards(index).count() == 0 and index.count() == 0


def test_damage_is_found():
    record = records.frame(b"some ids")
    assert records.unframe(record) == b"some ids"
    for at in (0, 9, 13, len(record) - 1):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))


def test_packing(spark):
    docs = documents(spark, [WITHOUT_ID, rows()[0]])
    pieces = packing.cut_pieces(docs, capacity=256)
    placed = packing.place_pieces(pieces, capacity=256)
    found = placed.collect()
    expected = []
    for text in [*texts().values(), WITHOUT_ID[1], texts()[0]]:
        ids = [*library_ids(text), 0]
        expected += [(k, ids[k : k + 256]) for k in range(0, len(ids), 256)]
    want = sorted((k, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for k, x in expected)
    assert sorted((r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
        assert sum(n for _, n in parts) <= 256
    total = sum(n for _, n, _ in want)
    assert len(bins) <= math.ceil(total / 256) * 1.05 + 1
    sequences = packing.build_sequences(pieces, placed).collect()
    assert len(sequences) == len(bins)
    assert sum(s["n_tokens"] for s in sequences) == total
    dtype = encoder().dtype
    words = sorted(tuple(x) for _, x in expected)
    got = []
    for s in sequences:
        ids = np.frombuffer(s["ids"], dtype=dtype)
        got += [tuple(p.tolist()) for p in np.split(ids, s["offsets"][1:])]
    assert sorted(got) == words


def test_packing_nothing(spark):
    pieces = packing.cut_pieces(nothing(spark))
    assert packing.place_pieces(pieces).count() == 0


def test_plan_exchanges_the_smallest_piece():
    # Greedy filling of 10 takes 6 + 3 and leaves 1; exchanging 3 for 2 + 2 fills the bin.
    plan = packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == ((6, 2, 2), 1)
    assert sorted(n for filling, times in plan for n in filling * times) == [2, 2, 3, 6]


def test_plan_uses_every_piece():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 101, 5000)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.plan_bins(counts, 100)
    used = {}
    for filling, times in plan:
        assert sum(filling) <= 100
        for n in filling:
            used[n] = used.get(n, 0) + times
    assert used == counts
    assert sum(times for _, times in plan) <= math.ceil(lengths.sum() / 100) * 1.01 + 1
