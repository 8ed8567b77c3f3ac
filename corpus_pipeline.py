"""A training corpus from raw documents: filter, deduplicate, mix and pack.

Each stage takes the documents that its predecessor kept and returns documents in the same columns;
the last returns packed sequences. ``run`` writes every stage's result as a table and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wellspark.llm import curriculum, packing, similar, substrings, toxicity
from wellspark.llm.arrow import table
from wellspark.staging import prepare, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not hold for toxic."""
    prepare(spark)
    return toxicity.keep_clean(docs, toxicity.fit_model(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word Jaccard of at least 0.8."""
    prepare(spark)
    return similar.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    prepare(spark)
    return substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target asks for."""
    prepare(spark)
    return curriculum.training_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    prepare(spark)
    pieces = packing.cut_pieces(docs)
    return packing.build_sequences(pieces, packing.place_pieces(pieces))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack),
]

# Tokenising, string kernels and fingerprint groups cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
