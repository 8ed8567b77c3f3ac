"""Spelling variants: words one edit apart, by an index of variable-length grams.

Dictionary: grams of 2 characters, and those frequent ones' extensions up to 4. A gram is frequent if it
holds more than one in ``FREQUENT`` of all grams of its length, so the dictionary has fewer than
``2 * FREQUENT`` frequent grams whatever the number of words. Words stand between two marks.

Decomposition: at each place of a word begins the shortest gram that is not frequent (the longest allowed
one, or the rest of the word, if all are). It depends on its own characters alone.

Affected grams: an edit touches the grams that hold its place, and no others. For each block of three
places, the grams that an edit anywhere in the block may touch are bounded by the word itself; all its other
grams must be in the other word too, those left of the block as far from the beginning, those right of it as
far from the end. The lists of all these grams are merged at once: words meet where all are equal. For
insertions into the shorter word the right side is one place nearer.

Verify: words that met differ by one code point where the word without one of the block's places is also the
other's word without that place (replaced), or the other word itself (inserted, deleted). So a list is
verified in one pass, not pair by pair. A list longer than ``LONG_LIST`` is not held: its rows are exchanged
once more by these shortened words, which leaves groups no larger than an alphabet.

Null texts have no words; rows without an id hash an empty id; repeated rows count each; words of any
length are compared whole; an empty table has no words. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.llm.arrow import schema_of, slices
from wellspark.staging import stage

SHORTEST, LONGEST = 2, 4
FREQUENT = 8192
BLOCK = 3
LONG_LIST = 4096
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BEGIN, _END = "\x02", "\x03"
# fixed values: kinds of rows of an index list
REPLACED_OR_LONGER, SHORTER = 0, 1
_ENTRY = "key bigint, word string, n bigint, place int"
_FOUND = "word string, near string, near_n bigint, key bigint, n bigint, place int"


def runs_of_letters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """``(row_id, run)``: every maximal run of letters of at least ``least``, A-Z in lower case."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))
    runs = docs.select(F.col(id_col).alias("row_id"), F.explode(found).alias("run"))
    small = F.lower("run")
    return runs.select("row_id", F.when(small == F.col("run"), F.col("run")).otherwise(F.translate("run", _UPPER, _UPPER.lower())).alias("run"))


def misspelt(row_id: Column, run: Column, one_in: int = 31) -> Column:
    """``run``, without one code point where the checksum of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def count_words(words: DataFrame, word_col: str = "word", min_length: int = 7, min_count: int = 2) -> DataFrame:
    """``(word, n)``."""
    long_enough = words.where(F.length(word_col) >= min_length)
    return long_enough.groupBy(F.col(word_col).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = schema_of("gram string, n bigint")
    for batch in slices(batches, 1 << 14):
        counts: Counter[str] = Counter()
        for word in batch.column(0).to_pylist():
            marked = _BEGIN + word + _END
            for size in range(SHORTEST, LONGEST):
                counts.update(marked[p : p + size] for p in range(len(marked) - size + 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), type=pa.int64())], schema=schema)


def frequent_grams(words: DataFrame, one_in: int = FREQUENT) -> set[str]:
    """Grams that are extended: fewer than ``one_in`` of each length."""
    counts = stage(words.select("word").mapInArrow(_grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    size = F.length("gram").alias("size")
    total = counts.groupBy(size).agg(F.sum("n").alias("total"))
    often = counts.withColumn("size", size).join(total, "size").where(F.col("n") * one_in > F.col("total"))
    return {r["gram"] for r in often.select("gram").collect()}


def decompose(marked: str, frequent: set[str]) -> list[int]:
    """Where the gram that begins at each place ends."""
    n, ends = len(marked), []
    for p in range(n - SHORTEST + 1):
        end = p + SHORTEST
        while end < n and end - p < LONGEST and marked[p:end] in frequent:
            end += 1
        ends.append(end)
    return ends


def index_keys(word: str, frequent: set[str], block: int = BLOCK) -> list[tuple[int, int]]:
    """``(key, place)`` of each block of places: ``place`` is twice the block's first place (from 0), plus the kind."""
    marked = _BEGIN + word + _END
    ends = decompose(marked, frequent)
    n, found = len(marked), []
    for first in range(0, len(word) + 1, block):
        at = first + 1  # in the marked word
        # The grams of a side stand at all its places: together they spell the stretch from its border on.
        left = marked[: max((e for e in ends[:at] if e <= at), default=0)]
        for kind in (REPLACED_OR_LONGER, SHORTER):
            if kind == REPLACED_OR_LONGER and first >= len(word):
                continue
            begin = at + block - kind
            right = marked[begin:] if begin < len(ends) else ""
            key = xxhash.xxh64_intdigest(f"{first}\x01{left}\x01{right}".encode()) - (1 << 63)
            found.append((key, 2 * first + kind))
    return found


def _index(batches: Iterable[pa.RecordBatch], frequent: set[str], block: int) -> Iterator[pa.RecordBatch]:
    schema = schema_of(_ENTRY)
    for batch in slices(batches, 4096):
        rows = [
            (key, word, n, place)
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for key, place in index_keys(word, frequent, block)
        ]
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, schema.types)], schema=schema)


def _shortened(word: str, place: int, block: int) -> Iterator[tuple[int, str, bool]]:
    """The word without each place of a block, and whether it stands for all places that give the same."""
    first = place // 2
    for i in range(first, min(first + block, len(word))):
        yield i, word[:i] + word[i + 1 :], i == 0 or word[i] != word[i - 1]


def _near_in(members: list[tuple[str, int, int]], block: int) -> Iterator[tuple[str, str, int]]:
    """Links among the ``(word, n, place)`` of one list, both ways."""
    replaced, longer = defaultdict(list), defaultdict(list)
    for word, n, place in members:
        if place % 2 == REPLACED_OR_LONGER:
            for i, rest, first in _shortened(word, place, block):
                replaced[i, rest].append((word, n))
                if first:
                    longer[rest].append((word, n))
    for same in replaced.values():
        if len(same) > 1:
            yield from ((a, b, m) for a, _ in same for b, m in same if a != b)
    for word, n, place in members:
        if place % 2 == SHORTER:
            for other, m in longer.get(word, ()):
                yield word, other, m
                yield other, word, n


def _unsettled(members: Iterable[tuple[str, int, int]], block: int) -> Iterator[tuple[int, str, int, int]]:
    """Entries of a long list by shortened words, for blocks of one place."""
    for word, n, place in members:
        if place % 2 == SHORTER:
            # Its longer partners come under the place that they lose; here it waits under its whole self.
            yield xxhash.xxh64_intdigest(f"-\x01{word}".encode()) - (1 << 63), word, n, place
            continue
        for i, rest, first in _shortened(word, place, block):
            yield xxhash.xxh64_intdigest(f"{i}\x01{rest}".encode()) - (1 << 63), word, n, 2 * i
            if first:
                yield xxhash.xxh64_intdigest(f"-\x01{rest}".encode()) - (1 << 63), word, n, 2 * i


def _merge(batches: Iterable[pa.RecordBatch], block: int, longest: int | None) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key to links; a list longer than ``longest`` goes on as entries of shortened words."""
    schema = schema_of(_FOUND)

    def links(found):
        rows = list(found)
        return [(a, b, m, None, None, None) for a, b, m in rows]

    def batch_from(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def open_rows(members):
        return [(word, None, None, key, n, place) for key, word, n, place in _unsettled(members, block)]

    key, members, is_long = None, [], False
    for batch in batches:
        out = []
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        columns = [batch.column(i).to_pylist() for i in (1, 2, 3)]
        for at, now in enumerate(keys.tolist()):
            if now != key:
                if len(members) > 1 and not is_long:
                    out.extend(links(_near_in(members, block)))
                key, members, is_long = now, [], False
            member = (columns[0][at], columns[1][at], columns[2][at])
            if is_long:
                out.extend(open_rows([member]))
                continue
            members.append(member)
            if longest is not None and len(members) > longest:
                out.extend(open_rows(members))
                members, is_long = [], True
            if len(out) > 1 << 14:
                yield batch_from(out)
                out = []
        if out:
            yield batch_from(out)
    if len(members) > 1 and not is_long and (rows := links(_near_in(members, block))):
        yield batch_from(rows)


def near_words(words: DataFrame, block: int = BLOCK, one_in: int = FREQUENT, longest: int = LONG_LIST) -> DataFrame:
    """``(word, near, near_n)``: for ``words (word, n)``, every two words one edit apart, once each way."""
    frequent = frequent_grams(words, one_in)
    entries = words.select("word", "n").mapInArrow(lambda b: _index(b, frequent, block), _ENTRY)
    met = entries.repartition("key").sortWithinPartitions("key")
    found = stage(met.mapInArrow(lambda b: _merge(b, block, longest), _FOUND), "near-words")
    again = found.where("near IS NULL").select("key", "word", "n", "place").repartition("key").sortWithinPartitions("key")
    rest = again.mapInArrow(lambda b: _merge(b, 1, None), _FOUND)
    columns = ["word", "near", "near_n"]
    return found.where("near IS NOT NULL").select(*columns).unionByName(rest.select(*columns).distinct())


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words that have a form, by pointer jumping; a form is ten times as frequent, so chains are short."""
    now = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = stage(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def group_variants(words: DataFrame, times: int = 10, **options) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for ``words (word, n)``: ``form`` is the most frequent near word if it is
    ``times`` as frequent, ``root`` where forms lead to."""
    links = near_words(words, **options)
    best = links.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    met = words.join(best, "word", "left")
    usual = -F.col("best.less") >= F.col("n") * times
    met = met.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n")
    )
    met = stage(met, "variants")
    roots = _roots(met.where("form IS NOT NULL"))
    return met.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
