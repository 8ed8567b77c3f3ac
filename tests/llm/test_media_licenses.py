import hashlib
import re
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.data import WITHOUT_ID, documents, nothing, rows, texts
from wellspark.llm import licenses, media


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=9000))
def test_container_round_trip(data):
    payload = media.pad(data)
    assert len(payload) % 64 == 0 and payload[: len(data)] == data and payload
    stored = media.wrap(payload)
    (track,) = media.inspect(stored)
    assert media.payload_of(stored, track) == payload
    assert (track.codec, track.handler, track.timescale) == ("raw ", "vide", media.RATE)
    frames = len(payload) // 64
    assert track.duration == len(track.sizes) == frames
    assert track.keys.tolist() == list(range(0, frames, media.KEY_EVERY))
    for k in track.keys:
        assert stored[track.offsets[k] : track.offsets[k] + track.sizes[k]] == payload[64 * k : 64 * k + 64]


def test_wide_offsets():
    offsets = np.array([(1 << 32) + 5, (1 << 32) + 5 + 64 * media.PER_CHUNK])
    boxes = {b.kind: b for b in media.walk(media._moov(media.PER_CHUNK + 1, offsets))}
    assert b"co64" in boxes and b"stco" not in boxes


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def numbers(*values):
    return struct.pack(f">{len(values)}I", *values)


def test_uneven_samples_two_tracks_and_large_boxes():
    def trak(handler, codec, sizes, chunks, runs, keys):
        tables = [
            box(b"stsd", numbers(0, 1), box(codec, bytes(28))),
            box(b"stts", numbers(0, 2, 1, 10, len(sizes) - 1, 5)),
            box(b"stsc", numbers(0, len(runs)), *[numbers(*r) for r in runs]),
            box(b"stsz", numbers(0, 0, len(sizes), *sizes)),
            box(b"stco", numbers(0, len(chunks), *chunks)),
        ]
        if keys:
            tables.append(box(b"stss", numbers(0, len(keys), *keys)))
        head = struct.pack(">IQQIQI", 1 << 24, 0, 0, 1000, 77, 0)
        return box(b"trak", box(b"mdia", box(b"mdhd", head), box(b"hdlr", numbers(0, 0), handler, bytes(13)), box(b"minf", box(b"stbl", *tables))))

    moov = box(b"moov", trak(b"vide", b"avc1", [3, 4, 5, 6], [20, 40], [(1, 3, 1), (2, 1, 1)], [1, 4]), trak(b"soun", b"mp4a", [2, 2], [60], [(1, 2, 1)], None))
    large = struct.pack(">I4sQ", 1, b"mdat", 16 + 100) + bytes(100)
    data = box(b"ftyp", b"isom", bytes(4)) + large + box(b"free") + box(b"uuid", bytes(16), b"own") + moov
    video, audio = media.inspect(data)
    assert (video.codec, video.timescale, video.duration) == ("avc1", 1000, 25)
    assert video.offsets.tolist() == [20, 23, 27, 40] and video.keys.tolist() == [0, 3]
    assert (audio.codec, audio.handler) == ("mp4a", "soun") and audio.offsets.tolist() == [60, 62] and audio.keys.tolist() == [0, 1]
    open_end = data[:-len(moov)] + struct.pack(">I4s", 0, b"moov") + moov[8:]
    assert media.inspect(open_end)[0].offsets.tolist() == video.offsets.tolist()


def test_damaged_containers(spark):
    good = media.wrap(media.pad(b"x" * 500))
    bad = [b"", b"abc", good[:100], good[:-1], b"\0\0\0\x04abcd", box(b"moov", box(b"trak")), None]
    for at in range(24, 600, 5):
        broken = bytearray(good)
        broken[at] ^= 0x80
        try:
            media.inspect(bytes(broken))
        except ValueError:
            pass
    found = media.media_features(spark.createDataFrame([(i, 0, b) for i, b in enumerate(bad)], media.STORED)).collect()
    assert len(found) == len(bad)
    assert all(r["codec"] is None and r["error"] for r in found if r["row_id"] != 5)


def test_stored_texts(spark):
    docs = documents(spark, [WITHOUT_ID, rows()[0]])
    found = media.media_features(media.store_texts(docs)).collect()
    assert len(found) == len(texts()) + 2
    for r in found:
        text = WITHOUT_ID[1] if r["row_id"] is None else texts()[r["row_id"]]
        data = (text or "").encode()
        assert bytes(r["payload"]) == media.pad(data) and r["n_bytes"] == len(data) and r["error"] is None
        assert r["key_sizes"] == [64] * len(r["key_offsets"])
    assert media.media_features(media.store_texts(nothing(spark))).count() == 0


def brute_canonical(text):
    text = re.sub(r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$", " ", text.lower())
    found = re.findall(r"[^\W_]+", text)
    return " ".join(licenses.EQUIVALENT.get(w, w) for w in found)


def test_license_scan(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    changed = "\n".join(["Copyright (c) 2020 Someone", "  (C) 2021 Other", mit.upper().replace(",", " ;")])
    odd = [
        (900, mit, "r"),
        (901, changed, "r"),
        (902, mit + " and more", "r"),
        (903, "words\nLicenced   under the Apache LICENCE - Version 2.0\nreleased under the MIT licence", "r"),
        (904, "Released under the MIT License, mostly", "r"),
        (905, "Copyright 1999 only", "r"),
        (905, "Licensed under CC BY-NC 4.0.", "r"),
    ]
    docs = documents(spark).select("doc_id", "text", "row").union(spark.createDataFrame([*odd, (None, mit, "r")], "doc_id bigint, text string, row string"))
    found = licenses.scan(docs).collect()
    assert len(found) == len(texts()) + 8
    by_id = {r["row_id"]: r for r in found}
    assert by_id[900]["license"] == by_id[901]["license"] == by_id[None]["license"] == "MIT"
    assert by_id[902]["license"] is None and by_id[904]["notices"] == []
    assert by_id[903]["notices"] == ["Apache-2.0", "MIT"] and by_id[903]["license"] is None
    assert by_id[905]["notices"] == ["CC-BY-NC-4.0"] and by_id[None]["notices"] == []
    for i, text in texts().items():
        want = None if text is None else hashlib.sha256(brute_canonical(text).encode()).hexdigest()
        assert by_id[i]["digest"] == want, i
    assert licenses.scan(nothing(spark)).count() == 0


def test_scan_runs_no_python(spark):
    plan = licenses.scan(documents(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
