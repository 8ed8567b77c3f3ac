"""Media columns: ISO media containers without decoding their payloads.

``inspect`` walks the nested boxes of a file, decodes each track's sample tables and gives the codec,
duration and the byte ranges of all samples and key frames. ``wrap`` stores bytes losslessly as a raw
8-bit grey video track: every 64 bytes are one 8 x 8 picture, with a key frame mark every
``KEY_EVERY`` pictures; ``payload_of`` reads them back through the sample table.

Null texts are empty; every payload has at least one picture; equal payloads give equal files;
repeated rows are stored each; a column value that is no readable container gives null features and
the reason in ``error``; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm.arrow import batch_of, schema_of, slices, utf8

SIDE = 8
FRAME = SIDE * SIDE
RATE = 25
KEY_EVERY = 12
PER_CHUNK = 32
# Fixed values of the container format: boxes that hold boxes, and those of them that begin with a version.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf", b"meta"))
VERSIONED = frozenset((b"meta",))


@dataclass
class Box:
    kind: bytes
    start: int
    body: int
    end: int
    path: tuple[bytes, ...]


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[Box]:
    """All boxes of a file in order, outer ones before those they hold."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError(f"box cut off at byte {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"box cut off at byte {start}")
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        stop = start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at byte {start} does not fit")
        yield Box(kind, start, body, stop, path)
        if kind in CONTAINERS:
            yield from walk(data, body + 4 * (kind in VERSIONED), stop, (*path, kind))
        start = stop


@dataclass
class Track:
    """One track's tables; offsets and sizes are per sample, keys are sample numbers from 0."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray | None = None
    sizes: np.ndarray | None = None
    keys: np.ndarray | None = None


def _table(data: bytes, box: Box, columns: int, kind: str = ">u4") -> np.ndarray:
    """Entries of a box with a version, a count and rows of numbers."""
    count = struct.unpack_from(">I", data, box.body + 4)[0]
    width = np.dtype(kind).itemsize * columns
    if box.body + 8 + count * width > box.end:
        raise ValueError(f"table {box.kind!r} is cut off")
    return np.frombuffer(data, dtype=kind, count=count * columns, offset=box.body + 8).astype(np.int64).reshape(count, columns)


def _sizes(data: bytes, box: Box) -> np.ndarray:
    if box.kind == b"stsz":
        fixed, count = struct.unpack_from(">II", data, box.body + 4)
        if fixed:
            return np.full(count, fixed, dtype=np.int64)
        if box.body + 12 + 4 * count > box.end:
            raise ValueError("table of sample sizes is cut off")
        return np.frombuffer(data, dtype=">u4", count=count, offset=box.body + 12).astype(np.int64)
    bits, count = struct.unpack_from(">BI", data, box.body + 7)
    raw = np.frombuffer(data, dtype=np.uint8, count=-(-count * bits // 8), offset=box.body + 12)
    if bits == 4:
        raw = np.column_stack([raw >> 4, raw & 15]).ravel()
    return (raw.view(">u2") if bits == 16 else raw)[:count].astype(np.int64)


def _track(data: bytes, boxes: list[Box]) -> Track:
    track, of = Track(), {b.kind: b for b in reversed(boxes)}
    if b := of.get(b"hdlr"):
        track.handler = data[b.body + 8 : b.body + 12].decode("latin-1")
    if b := of.get(b"mdhd"):
        wide = data[b.body] == 1
        track.timescale, track.duration = struct.unpack_from(">IQ" if wide else ">II", data, b.body + (20 if wide else 12))
    if b := of.get(b"stsd"):
        track.codec = data[b.body + 12 : b.body + 16].decode("latin-1")
    if b := of.get(b"stts"):
        times = _table(data, b, 2)
        track.duration = int((times[:, 0] * times[:, 1]).sum())
    box = of.get(b"stsz") or of.get(b"stz2")
    track.sizes = _sizes(data, box) if box else np.empty(0, dtype=np.int64)
    count = len(track.sizes)
    chunks = np.empty(0, dtype=np.int64)
    if b := of.get(b"stco"):
        chunks = _table(data, b, 1)[:, 0]
    elif b := of.get(b"co64"):
        chunks = _table(data, b, 1, ">u8")[:, 0]
    if count:
        runs = _table(data, of[b"stsc"], 3)
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks))))
        chunk = np.repeat(np.arange(len(chunks)), per_chunk)[:count]
        if len(chunk) < count:
            raise ValueError("fewer samples in chunks than sizes")
        before = np.cumsum(track.sizes) - track.sizes
        first = np.searchsorted(chunk, chunk)
        track.offsets = chunks[chunk] + before - before[first]
        if (track.offsets + track.sizes > len(data)).any():
            raise ValueError("a sample lies past the end")
    else:
        track.offsets = np.empty(0, dtype=np.int64)
    track.keys = _table(data, of[b"stss"], 1)[:, 0] - 1 if b"stss" in of else np.arange(count)
    if len(track.keys) and (track.keys.min() < 0 or track.keys.max() >= count):
        raise ValueError("a key frame has no sample")
    return track


def inspect(data: bytes) -> list[Track]:
    """Tracks of a container; raises ValueError for what is no readable container."""
    tracks: list[list[Box]] = []
    for box in walk(data):
        if box.kind == b"trak":
            tracks.append([])
        elif b"trak" in box.path and tracks:
            tracks[-1].append(box)
    if not tracks:
        raise ValueError("no track")
    try:
        return [_track(data, boxes) for boxes in tracks]
    except (KeyError, struct.error) as e:
        raise ValueError(f"incomplete tables: {e}") from e


def payload_of(data: bytes, track: Track) -> bytes:
    """All samples of a track, in order."""
    stops = track.offsets + track.sizes
    cuts = np.flatnonzero(track.offsets[1:] != stops[:-1]) + 1
    firsts, lasts = np.append(0, cuts), np.append(cuts - 1, len(stops) - 1)
    return b"".join(data[track.offsets[a] : stops[b]] for a, b in zip(firsts, lasts)) if len(stops) else b""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _numbers(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes) -> bytes:
    """The bytes, and zeros up to a positive multiple of a picture."""
    return data + bytes(-len(data) % FRAME or (0 if data else FRAME))


def _moov(frames: int, offsets: np.ndarray) -> bytes:
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    rest = frames % PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] if frames >= PER_CHUNK else []
    if rest:
        runs.append((len(offsets), rest, 1))
    wide = bool(offsets[-1] >> 32)
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", SIDE, SIDE), _numbers(0x480000, 0x480000, 0),
        struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 40, -1),
    )
    tables = _box(
        b"stbl",
        _full(b"stsd", _numbers(1), entry),
        _full(b"stts", _numbers(1, frames, 1)),
        _full(b"stss", _numbers(len(keys)), keys.tobytes()),
        _full(b"stsc", _numbers(len(runs)), *[_numbers(*r) for r in runs]),
        _full(b"stsz", _numbers(FRAME, frames)),
        _full(b"co64" if wide else b"stco", _numbers(len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    source = _box(b"dinf", _full(b"dref", _numbers(1), _full(b"url ", flags=1)))
    media = _box(
        b"mdia",
        _full(b"mdhd", _numbers(0, 0, RATE, frames), struct.pack(">HH", 0x55C4, 0)),
        _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"),
        _box(b"minf", _full(b"vmhd", bytes(8), flags=1), source, tables),
    )
    track_head = _full(
        b"tkhd", _numbers(0, 0, 1, 0, frames), bytes(16), _UNITY, _numbers(SIDE << 16, SIDE << 16), flags=7
    )
    head = _full(b"mvhd", _numbers(0, 0, RATE, frames, 0x10000), struct.pack(">H", 0x100), bytes(10), _UNITY, bytes(24), _numbers(2))
    return _box(b"moov", head, _box(b"trak", track_head, media))


def wrap(payload: bytes) -> bytes:
    """A container with the payload, whose length is a positive multiple of a picture."""
    if not payload or len(payload) % FRAME:
        raise ValueError("a payload is whole pictures")
    frames = len(payload) // FRAME
    brand = _box(b"ftyp", b"qt  ", _numbers(0), b"qt  ", b"isom")
    starts = np.arange(0, len(payload), FRAME * PER_CHUNK, dtype=np.int64)
    # The index stands before the payload; its size depends on the offsets only through their width.
    wide = len(payload) + (1 << 24) >= 1 << 32
    head = len(brand) + len(_moov(frames, starts + ((1 << 32) if wide else 0))) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return brand + _moov(frames, starts + head) + _box(b"mdat", payload)


STORED = "row_id bigint, n_bytes bigint, media binary"
FEATURES = (
    "row_id bigint, n_bytes bigint, media binary, payload binary, codec string, timescale bigint, duration bigint, "
    "samples bigint, key_offsets array<bigint>, key_sizes array<bigint>, error string"
)


def _wrap(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = schema_of(STORED)
    for batch in slices(batches):
        texts = utf8(batch.column(1).to_pylist())
        columns = [batch.column(0), pa.array([len(t) for t in texts]), pa.array([wrap(pad(t)) for t in texts], type=pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row_id, n_bytes, media)``: each whole text as a container."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(_wrap, STORED)


def _inspect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = schema_of(FEATURES)
    for batch in slices(batches):
        rows = []
        for data in batch.column(2).to_pylist():
            try:
                track = inspect(data or b"")[0]
                keys = track.keys
                rows.append((payload_of(data, track), track.codec, track.timescale, track.duration, len(track.sizes), track.offsets[keys], track.sizes[keys], None))
            except ValueError as e:
                rows.append((None, None, None, None, None, None, None, str(e)))
        found = batch_of(list(zip(*rows)), schema.names[3:], schema.types[3:])
        yield pa.RecordBatch.from_arrays([*batch.columns, *found.columns], schema=schema)


def media_features(stored: DataFrame) -> DataFrame:
    """Codec, duration and key frame byte ranges of each container's first track, and its payload as stored."""
    return stored.select("row_id", "n_bytes", "media").mapInArrow(_inspect, FEATURES)
