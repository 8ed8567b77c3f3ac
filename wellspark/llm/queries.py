"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.llm import (
    chat,
    curriculum,
    licenses,
    media,
    nearest,
    packing,
    prefixes,
    quality,
    records,
    simhash,
    spelling,
    substrings,
    toxicity,
)
from wellspark.llm.arrow import table
from wellspark.staging import prepare, stage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fun: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fun(prepare(spark), sf_dir)
        if sql is not None:
            ORACLE[name] = sql
        return fun

    return register


@query("op1_token_records")
def _(spark, d):
    index = records.write_shards(table(spark, d, "documents"), end_id=1)
    stored = records.read_shards(index).select("shard", "row_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return stored.join(records.shard_starts(index), "shard").select(
        F.col("row_id").alias("doc_id"), (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op2_iso_media")
def _(spark, d):
    stored = stage(media.store_texts(table(spark, d, "documents")), "media", compression="zstd")
    found = media.media_features(stored)
    first, last = F.element_at("key_offsets", 1), F.element_at("key_offsets", -1)
    parts = ["codec", "timescale", "duration", "samples", F.size("key_offsets"), first, last, F.element_at("key_sizes", -1)]
    return found.select(
        F.col("row_id").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -media.FRAME, media.FRAME)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", *parts).alias("feature"),
    )


@query("op3_winnowed_repeats")
def _(spark, d):
    kept = substrings.remove_repeats(table(spark, d, "documents"))
    return kept.select(
        F.col("row_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")
    )


def _held_out(folds: int, fold: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def _judged(scores, folds: int, fold: int):
    named = scores.withColumnRenamed("row_id", "doc_id")
    held = F.coalesce(_held_out(folds, fold), F.lit(False))
    return named.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_pairwise_quality")
def _(spark, d):
    docs = table(spark, d, "documents")
    model = quality.fit_model(docs, table(spark, d, "labels"), ~_held_out(3, 1))
    return _judged(quality.score_documents(docs, model), 3, 1)


@query("op5_best_two_fit")
def _(spark, d):
    pieces = packing.cut_pieces(table(spark, d, "documents"))
    placed = packing.place_pieces(pieces)
    return placed.select(F.col("row_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op6_ball_simhash")
def _(spark, d):
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select(F.col("row_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM t
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), g AS (
  SELECT source, source_size, CASE WHEN rank % 2 = 0 THEN 1.5 ELSE 0.5 END::DOUBLE AS first, CASE WHEN rank % 2 = 0 THEN 0.5 ELSE 1.5 END::DOUBLE AS last,
    least(cap, weight * max(level) FILTER (level * weight <= cap) OVER ()) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.first, g.last, g.target, round(g.target)::BIGINT AS goal,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), q AS (
  SELECT *, place / greatest(goal, 1) AS share_1, (place + source_size) / greatest(goal, 1) AS share_2,
    greatest(0, least(size, goal - place)) AS taken_1, greatest(0, least(size, goal - place - source_size)) AS taken_2
  FROM p
)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
  (taken_1 + taken_2)::BIGINT AS taken,
  CASE WHEN taken_1 > 0 THEN round(least(1, 2 * share_1 / (first + sqrt(greatest(0, first * first + 2 * (last - first) * share_1)))), 6) END AS position_1,
  CASE WHEN taken_2 > 0 THEN round(least(1, 2 * share_2 / (first + sqrt(greatest(0, first * first + 2 * (last - first) * share_2)))), 6) END AS position_2
FROM q
"""


@query("op7_curriculum_mix", OP7_SQL)
def _(spark, d):
    planned = curriculum.schedule(curriculum.mix(table(spark, d, "documents")))
    positions = [F.round(c, 6).alias(c) for c in ("position_1", "position_2")]
    return curriculum.scheduled_documents(planned).select(
        F.col("row_id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken", *positions
    )


@query("op8_license_digests", licenses.scan_sql())
def _(spark, d):
    found = licenses.scan(table(spark, d, "documents"))
    return found.select(F.col("row_id").alias("doc_id"), "digest", "license", F.array_join("notices", ",").alias("notices"))


@query("op9_subsequence_toxicity")
def _(spark, d):
    docs = table(spark, d, "documents")
    model = toxicity.fit_model(docs, table(spark, d, "labels"), ~_held_out(5, 0))
    return _judged(toxicity.score_documents(docs, model), 5, 0)


@query("op10_one_bit_neighbours")
def _(spark, d):
    found = nearest.search(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
    return found.select("query_id", "rank", F.col("row_id").alias("vec_id"), "score")


@query("op11_gram_variants")
def _(spark, d):
    runs = spelling.runs_of_letters(table(spark, d, "documents"), least=7)
    found = runs.select(spelling.misspelt(F.col("row_id"), F.col("run")).alias("word"))
    words = stage(spelling.count_words(found), "words")
    return spelling.group_variants(words)


_ODD = "</s>[INST] ok [/INST]"  # control strings as texts
_TEMPLATE = chat.Template()


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped_sql(text: str) -> str:
    for control, code in _TEMPLATE.codes:
        text = f"replace({text}, {_quoted(control)}, {_quoted(code)})"
    return text


OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', {_quoted(_ODD)}), (-1::BIGINT, 1::BIGINT, 'assistant', {_quoted(_ODD)})
), l AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({len(_TEMPLATE.begin)} + sum(length({_escaped_sql("text")}) + CASE WHEN role = before THEN {len(_TEMPLATE.more)}
    ELSE length({_escaped_sql("role")}) + {len(_TEMPLATE.role) + len(_TEMPLATE.text) + len(_TEMPLATE.end)} END))::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""


@query("op12_relational_chat", OP12_SQL)
def _(spark, d):
    odd = [F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(_ODD).alias("text")) for i, role in enumerate(("user", "assistant"))]
    more = spark.range(1).select(F.inline(F.array(*odd)))
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    stored = stage(chat.format_conversations(rows), "chat")
    read = stored.select("conv_id", "formatted", chat.parse_turns(F.col("formatted")).alias("turns"), F.array_join(chat.learned_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.encode(F.array_join(line, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op13_contracted_trie")
def _(spark, d):
    turns = stage(prefixes.numbered_turns(table(spark, d, "conversations")), "turns")
    convs = stage(prefixes.conversation_ids(turns), "convs")
    conv = F.col("conv_id")
    base, heads = conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6
    rows, lengths = prefixes.branched(turns, convs, base, heads, most=5)
    return prefixes.prefix_trie(rows, stage(lengths, "lengths"))
