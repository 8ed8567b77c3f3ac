"""Quality scores by Bradley-Terry pairwise ranking.

Every document has features of its whole text: shares of kinds of characters and words, repetition,
lengths. A feature enters the model as indicators of the training deciles it lies above, so the score
is a sum of step functions. For pairs of a good and a bad training document the model learns that
the good one wins with probability 1 / (1 + exp(-(score difference))): logistic loss on feature
differences. The border is the quantile of the training scores that leaves the training share of good
documents above it, half way between its neighbours; the score given out is the logistic curve around it.

Training reads at most ``max_train`` labelled documents (by a hash of their id) and ``PAIRS`` pairs of
them; scoring reads every text whole. Null texts count as empty; null labels are not learned from;
repeated rows are each scored; labels of one kind alone give every document that label; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.llm.arrow import schema_of, slices, utf8
from wellspark.llm.wordhash import hashes_of, joined, runs_of, word_borders

MAX_TRAIN = 20_000
PAIRS = 60_000
STEPS = 12
_HASHED_ROWS = 64  # texts hashed at a time
FEATURES = (
    "log_words log_bytes word_length word_length_spread upper digits symbols letters capital_words signed_words "
    "bare_words junk_endings sentence_ends repeated_next distinct_words distinct_runs top_word lines"
).split()
_KIND = np.full(256, 4, dtype=np.int8)  # 0 space, 1 lower case and non-ASCII, 2 upper case, 3 digit, 4 sign
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    data, borders = joined(texts)
    kind = _KIND[data]
    starts, ends = word_borders(data)
    first = np.searchsorted(starts, borders)

    def per_text(marks: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marks, dtype=np.float64)))
        return np.diff(sums[cuts])

    lower, upper, digits, signs = (per_text(kind == k, borders) for k in (1, 2, 3, 4))
    bytes_ = np.maximum(lower + upper + digits + signs, 1)
    words = np.maximum(np.diff(first), 1)
    length = (ends - starts).astype(np.float64)
    mean = per_text(length, first) / words
    spread = np.sqrt(np.maximum(per_text(length**2, first) / words - mean**2, 0))
    last, last_kind = data[ends - 1], kind[ends - 1]
    before = np.where(length > 1, kind[np.maximum(ends - 2, 0)], 0)
    sums = {k: np.concatenate(([0], np.cumsum(kind == k))) for k in (1, 2, 4)}
    of = {k: s[ends] - s[starts] for k, s in sums.items()}
    hashes = hashes_of(data, starts, ends)
    same = np.zeros(len(hashes))
    same[1:] = hashes[1:] == hashes[:-1]
    distinct, runs, top = np.ones(len(texts)), np.ones(len(texts)), np.zeros(len(texts))
    for i in range(len(texts)):
        own = hashes[first[i] : first[i + 1]]
        if len(own):
            _, counts = np.unique(own, return_counts=True)
            distinct[i], top[i] = len(counts) / len(own), counts.max() / len(own)
            if len(own) > 3:
                runs[i] = len(np.unique(runs_of(own, 3))) / (len(own) - 2)
    columns = [
        np.log1p(np.diff(first)),
        np.log1p(np.diff(borders) - 1),
        mean,
        spread,
        upper / np.maximum(lower + upper, 1),
        digits / bytes_,
        signs / bytes_,
        (lower + upper) / bytes_,
        per_text((of[2] == length) & (length > 1), first) / words,
        per_text(of[4] > 0, first) / words,
        per_text(of[1] + of[2] == 0, first) / words,
        per_text((last_kind == 4) & (before == 4), first) / words,
        per_text(np.isin(last, (0x2E, 0x2C, 0x3F, 0x21, 0x3B, 0x3A)), first) / words,
        per_text(same, first) / words,
        distinct,
        runs,
        top,
        per_text(data == 0x0A, borders) / words,
    ]
    return np.column_stack(columns)


@dataclass
class QualityModel:
    """Step borders ``(features, steps)``, a weight for each, and the border of the raw score."""

    steps: np.ndarray
    weights: np.ndarray
    border: float

    def indicators(self, x: np.ndarray) -> np.ndarray:
        return (x[:, :, None] > self.steps).reshape(len(x), -1).astype(np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.indicators(x) @ self.weights - self.border
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 0) -> QualityModel:
    """Model from feature rows and labels."""
    steps = np.quantile(x, np.linspace(0.02, 0.98, STEPS), axis=0).T if len(x) else np.zeros((len(FEATURES), STEPS))
    model = QualityModel(steps, np.zeros(len(FEATURES) * STEPS), 0.0)
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    if not len(good) or not len(bad):
        model.border = -20.0 if len(good) else 20.0
        return model
    rng = np.random.default_rng(seed)
    marks = model.indicators(x)
    difference = marks[rng.choice(good, pairs)] - marks[rng.choice(bad, pairs)]
    w = model.weights
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
        gradient = difference.T @ (p - 1) + ridge * w
        hessian = difference.T @ (difference * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    scores = np.sort(marks @ w)
    model.border = float(scores[len(bad) - 1 : len(bad) + 1].mean())
    return model


_ROW = "row_id bigint, features array<double>"


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = schema_of(_ROW)
    for batch in slices(batches, _HASHED_ROWS):
        rows = text_features(utf8(batch.column(1).to_pylist()))
        values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(schema.types[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), values], schema=schema)


def fit_model(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_train: int = MAX_TRAIN) -> QualityModel:
    """Fits on labelled documents; only their features come to the driver, ``max_train`` rows at most."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks if learn is None else marks.where(learn)
    chosen = marks.select(F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("label"))
    chosen = chosen.orderBy(F.md5(F.col("row_id").cast("string")), "label").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("row_id"), F.col("text").alias("body"))
    rows = texts.join(F.broadcast(chosen), "row_id")
    found = rows.select("row_id", "body").mapInArrow(_features, _ROW).join(F.broadcast(chosen), "row_id").collect()
    found.sort(key=lambda r: (r["row_id"], r["label"], r["features"]))
    return fit(np.array([r["features"] for r in found]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in found]))


def _score(batches: Iterable[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    schema = schema_of("row_id bigint, score double")
    for batch in slices(batches, _HASHED_ROWS):
        score = model.score(text_features(utf8(batch.column(1).to_pylist())))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], schema=schema)


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row_id, score)``; 0.5 is the border."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(lambda b: _score(b, model), "row_id bigint, score double")
