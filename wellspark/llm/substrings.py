"""Exact substring deduplication by seed and extend on winnowed anchors.

A passage is a run of at least ``min_words`` words. Every word covered by a run of ``min_words``
words that also starts in a document with a smaller id is removed; all comparisons are made on
the input.

Seed: of the ``anchor_words``-word runs inside a window of ``min_words`` words, the one with the
smallest hash (the last of equals) is the window's anchor. It depends on the window's words
alone, so equal windows have equal anchors, and about a fifth of the positions are anchors. An
anchor's extent is the stretch of words of all windows that it anchors.

Extend: occurrences of an anchor meet in one exchange, sorted by extent and document. Occurrences
with the extent of an earlier document match along all of it - inside a shared passage every
extent does, so neighbouring extents make up the maximal repeat. Where an anchor has different
extents, at the ends of shared passages, only the first document of each extent is left open;
its windows are then compared one by one.

A hot passage is settled where it is read: within a slice of some thousand documents only the smallest
document of each extent goes on to the exchange, the others leave as merged ranges, so a passage that a
third of all documents share sends one row per slice. Groups are read as sorted streams with constant
state; no group is gathered. Equality is by 64-bit hashes of word runs.

Null texts have no words; rows without an id are returned as they are and take no part; rows with
equal ids don't remove each other's words, whether their texts are equal or not; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm.arrow import batch_of, schema_of, slices, utf8
from wellspark.llm.wordhash import mix, runs_of, word_hashes
from wellspark.staging import stage

MIN_WORDS = 13
ANCHOR_WORDS = 5
_HASHED_ROWS = 64  # texts hashed at a time
_SETTLED_ROWS, _SETTLED_BYTES = 4096, 8 << 20  # texts whose common passages are settled at a time
# A document is its id and its text's hash, since an id may stand for several texts.
_ROW = "key bigint, extent bigint, row_id bigint, twin bigint, place bigint"
_RANGE = "row_id bigint, twin bigint, start int, n int, open boolean"
# A place is the number of the first window, shifted, and the count of windows; the sign marks a settled range.
_COUNT_BITS = 30


def _windows(texts: list[bytes], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, text borders, window hashes, and which windows lie inside one text."""
    hashes, first = word_hashes(texts)
    windows = runs_of(hashes, min_words)
    inside = np.ones(len(windows), dtype=bool)
    for border in first[1:-1]:
        inside[max(0, border - min_words + 1) : border] = False
    return hashes, first, windows, inside


def _anchors(texts: list[bytes], min_words: int, anchor_words: int):
    """Per anchor occurrence: text number, first window (from the text's start), windows, anchor hash, extent hash."""
    hashes, first, windows, inside = _windows(texts, min_words)
    if not len(windows):
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    seeds = runs_of(hashes, anchor_words)
    n = len(windows)
    least, owner = seeds[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, min_words - anchor_words + 1):
        other = seeds[j : j + n]
        better = other <= least
        least[better] = other[better]
        owner[better] = j
    owner += np.arange(n)
    begins = np.ones(n, dtype=bool)
    begins[1:] = (owner[1:] != owner[:-1]) | ~inside[:-1]
    at = np.flatnonzero(begins & inside)
    stops = np.flatnonzero(begins | ~inside)
    counts = np.append(stops, n)[np.searchsorted(stops, at, side="right")] - at
    extent = mix(windows[at] * np.uint64(3) + windows[at + counts - 1] + counts.astype(np.uint64))
    text = np.searchsorted(first, at, side="right") - 1
    return text, at - first[text], counts, seeds[owner[at]], extent


def _seed(batches: Iterable[pa.RecordBatch], min_words: int, anchor_words: int) -> Iterator[pa.RecordBatch]:
    schema = schema_of(_ROW)
    for settled in slices(batches, _SETTLED_ROWS, _SETTLED_BYTES):
        yield from _seed_slice(settled, schema, min_words, anchor_words)


def _seed_slice(rows: pa.RecordBatch, schema: pa.Schema, min_words: int, anchor_words: int) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for part in slices([rows], _HASHED_ROWS):
        found = _anchors(utf8(part.column(1).to_pylist()), min_words, anchor_words)
        parts.append((found[0] + size, *found[1:]))
        size += part.num_rows
    if not parts:
        return
    text, start, count, key, extent = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    ids, twins = rows.column(0).to_numpy(), rows.column(2).to_numpy()
    doc = ids[text]
    order = np.lexsort((doc, extent))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = extent[order][1:] != extent[order][:-1]
    group = np.cumsum(fresh) - 1
    settled = np.zeros(len(order), dtype=bool)
    settled[order] = doc[order] > doc[order][fresh][group]
    place = (start << _COUNT_BITS) | count
    open_ = ~settled
    yield _rows(schema, key[open_], extent[open_], doc[open_], twins[text[open_]], place[open_])
    # Rows of a text stand in order, so neighbours that touch are one range.
    text, start, count, doc = text[settled], start[settled], count[settled], doc[settled]
    if len(text):
        head = np.ones(len(text), dtype=bool)
        head[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + count[:-1])
        total = np.add.reduceat(count, np.flatnonzero(head))
        doc, start, twin = doc[head], start[head], twins[text[head]]
        spread = mix(doc.view(np.uint64) + start.view(np.uint64))
        yield _rows(schema, spread, spread, doc, twin, -((start << _COUNT_BITS) | total))


def _rows(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _ranges(doc, twin, place, open_) -> pa.RecordBatch:
    start, count = place >> _COUNT_BITS, place & ((1 << _COUNT_BITS) - 1)
    columns = [doc, twin, start.astype(np.int32), count.astype(np.int32), np.full(len(doc), open_)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema_of(_RANGE))


def _extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, extent, document) to removed ranges and, where an anchor has several extents,
    the open ranges of each extent's first document.

    Between batches it keeps the last anchor, extent and first document, and the occurrences of an
    anchor's only extent so far in its first document.
    """
    state = None  # key, extent, first document, several extents, (documents, twins, places) not yet given out
    for batch in batches:
        key, extent, doc, twin, place = (batch.column(i).to_numpy() for i in range(5))
        done = place < 0
        if done.any():
            yield _ranges(doc[done], twin[done], -place[done], False)
            key, extent, doc, twin, place = (x[~done] for x in (key, extent, doc, twin, place))
        if not len(key):
            continue
        if state is not None:
            last_row = (*state[:3], 0, 0)
            key, extent, doc, twin, place = (np.concatenate(([s], x)) for s, x in zip(last_row, (key, extent, doc, twin, place)))
        new_key = np.ones(len(key), dtype=bool)
        new_key[1:] = key[1:] != key[:-1]
        new_extent = new_key.copy()
        new_extent[1:] |= extent[1:] != extent[:-1]
        anchor = np.cumsum(new_key) - 1
        several = np.bincount(anchor[new_extent]) > 1
        waiting = (np.empty(0, dtype=np.int64),) * 3
        if state is not None:
            several[0] |= state[3]
            waiting = state[4]
        first = doc[new_extent][np.cumsum(new_extent) - 1]
        real = np.ones(len(key), dtype=bool)
        real[0] = state is None
        gone = real & (doc > first)
        if gone.any():
            yield _ranges(doc[gone], twin[gone], place[gone], False)
        lead = real & (doc == first)
        given = lead & several[anchor]
        if several[0] and len(waiting[0]):
            yield _ranges(*waiting, True)
        if given.any():
            yield _ranges(doc[given], twin[given], place[given], True)
        last = anchor == anchor[-1]
        held = lead & last & ~several[anchor]
        keep = (doc[held], twin[held], place[held])
        if anchor[-1] == 0 and not several[0]:
            keep = tuple(np.concatenate(x) for x in zip(waiting, keep))
        state = (key[-1], extent[-1], first[-1], bool(several[-1]), keep)


def _open_windows(batches: Iterable[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(row_id, twin, body, ranges)`` to one row per window of the ranges."""
    schema = schema_of(_ROW)
    for batch in slices(batches, _HASHED_ROWS):
        _, first, windows, _ = _windows(utf8(batch.column("body").to_pylist()), min_words)
        keys, places = [], []
        for i, ranges in enumerate(batch.column("ranges").to_pylist()):
            at = np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in ranges])
            keys.append(windows[first[i] + at])
            places.append((at << _COUNT_BITS) | 1)
        key, sizes = np.concatenate(keys), [len(k) for k in keys]
        docs, twins = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("row_id", "twin"))
        yield _rows(schema, key, key, docs, twins, np.concatenate(places))


KEPT = "n_words bigint, n_removed bigint, kept string"


def _cut(batches: Iterable[pa.RecordBatch], min_words: int, as_is: bool) -> Iterator[pa.RecordBatch]:
    schema = schema_of(KEPT)
    for batch in slices(batches):
        out = []
        bodies = batch.column("body").to_pylist()
        for body, text, ranges in zip(bodies, utf8(bodies), batch.column("ranges").to_pylist()):
            words = text.split()
            total = len(words)
            if ranges:
                keep = np.ones(total, dtype=bool)
                for r in ranges:
                    keep[r["start"] : r["start"] + r["n"] + min_words - 1] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            kept = body if as_is and not ranges else b" ".join(words).decode("utf-8")
            out.append((total, total - len(words), kept))
        found = batch_of(list(zip(*out)), schema.names, schema.types)
        carried = [batch.column("row_id"), batch.column("row")]
        yield pa.RecordBatch.from_arrays([*carried, *found.columns], names=["row_id", "row", *schema.names])


def _by_document(ranges: DataFrame) -> DataFrame:
    """A document's ranges in one row: as many as the document has windows at most."""
    return ranges.groupBy("row_id", "twin").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    anchor_words: int = ANCHOR_WORDS,
    carry: Sequence[str] = (),
    as_is: bool = False,
) -> DataFrame:
    """``(row_id, row, n_words, n_removed, kept)``: each text without its repeated passages, words joined by a
    space; with ``as_is`` a text without any comes as it is. ``row`` is a struct of the ``carry`` columns."""
    if not 0 < anchor_words <= min_words:
        raise ValueError("an anchor must fit into a window")
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("row_id"), F.xxhash64(text_col).alias("twin"), F.col(text_col).alias("body"), row.alias("row")
    )
    known = rows.where("row_id IS NOT NULL")
    seeds = known.select("row_id", "body", "twin").mapInArrow(lambda b: _seed(b, min_words, anchor_words), _ROW)
    met = seeds.repartition("key").sortWithinPartitions("key", "extent", "row_id")
    found = stage(met.mapInArrow(_extend, _RANGE), "ranges")
    undecided = _by_document(found.where("open"))
    # Both joins read the same columns of the same rows, so the texts are exchanged once. That needs the same filter on
    # both sides: an inner join drops rows without an id by itself, a left join doesn't.
    both, inputs = ["row_id", "twin"], ["row_id", "twin", "body", "row", "ranges"]
    single = known.join(undecided, both).select(*inputs).mapInArrow(lambda b: _open_windows(b, min_words), _ROW)
    compared = single.repartition("key").sortWithinPartitions("key", "row_id").mapInArrow(_extend, _RANGE)
    removed = _by_document(found.where("NOT open").unionByName(compared))
    whole = known.join(removed, both, "left").select(*inputs)
    nameless = rows.where("row_id IS NULL").withColumn("ranges", F.lit(None).cast(removed.schema["ranges"].dataType))
    kind = rows.schema["row"].dataType.simpleString()
    return whole.unionByName(nameless).mapInArrow(lambda b: _cut(b, min_words, as_is), f"row_id bigint, row {kind}, {KEPT}")


def without_repeats(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` with each text, and its length, after :func:`remove_repeats`; texts without repeats are unchanged."""
    others = [c for c in docs.columns if c != text_col]
    found = remove_repeats(docs, text_col=text_col, carry=others, as_is=True, **options)
    columns = {c: F.col("kept") if c == text_col else F.col("row")[c] for c in docs.columns}
    if length_col in columns:
        kind = docs.schema[length_col].dataType
        columns[length_col] = F.when(F.col("n_removed") > 0, F.length("kept").cast(kind)).otherwise(columns[length_col])
    return found.select(*[c.alias(name) for name, c in columns.items()])
