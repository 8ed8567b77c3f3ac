"""Toxic documents by a support vector machine on a subsequence string kernel with Nystroem landmarks.

A document's sentences are read as words; characters standing alone side by side ("s p a c e d")
count as one more word. The kernel of ``kernel.py`` (to the power ``DEGREE``) compares a word with
the landmarks: the beginnings of words that best tell toxic training documents from clean ones, and
common clean words. Nystroem features are K(w, L) K(L, L)^-1/2; a linear support vector machine on
them gives each word a margin, and a sentence or document has the margin of its worst word. Labels
are given for whole documents, so the word that stands for a toxic document is chosen anew after
each fit (multiple-instance training), clean documents are stood for by their worst words, and
disguised spellings of the toxic words - one more character between two letters - are trained on too. A
logistic curve fitted on the training margins, and on those of the weakest disguises, turns margins into
scores; 0.5 is the decision border.

Training reads at most ``max_train`` labelled documents (by a hash of their id), of each one text and at most
``MAX_WORDS`` distinct words (by their hash), so what it gathers is bounded however long the texts are and however
often an id is repeated; scoring reads every word of every text. Null and empty texts have the score of a document without any known word; null
labels are not learned from; repeated rows are each scored; with no usable labels, or only one kind,
every score is 0 where no toxic document is known. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.llm import kernel
from wellspark.llm.arrow import schema_of, slices
from wellspark.staging import stage

MAX_TRAIN = 4000
MAX_WORDS = 2000
_BLOCK = 2048  # words compared with the landmarks at a time in training
LANDMARKS = 64
DEGREE = 2
_SHORTEST, _LONGEST = 3, 12
_LEAST_GAIN = 5.0
_CACHE_WORDS = 120_000
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S)+(?!\S)")
_TRAINING = "doc_id bigint, label int, forms string"
_COUNTS = "start boolean, word string, toxic bigint, clean bigint"
_GAINS = "word string, gain double"
_NEAR = "doc_id bigint, label int, pieces array<string>"
_PICKED = "doc_id bigint, label int, rank int, piece string, near binary"
_TOPS = "doc_id bigint, label int, margin double"
SCORES = "row_id bigint, margin double, score double, word string"


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text in order, and runs of single characters as one word each."""
    if not text:
        return []
    text = text.lower()
    words = text.split()
    words.extend("".join(m.split()) for m in _SPACED.findall(text) if len(m) > 4)
    return words


@dataclass
class ToxicityModel:
    """Weights of the landmarks, the machine's offset, and the logistic curve of the scores."""

    landmarks: kernel.Landmarks | None
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def __post_init__(self):
        self._known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def forget(self) -> None:
        """Drops the margins of words seen so far: a worker is used again by later stages."""
        self._known.clear()

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))

    def margins(self, words: list[str]) -> list[float]:
        """Margin of each word, that of its worst piece."""
        if self.landmarks is None:
            return [self.offset] * len(words)
        forms = [kernel.pieces(kernel.normal_form(w)) for w in words]
        sizes = np.array([len(f) for f in forms])
        values = self.landmarks.products([p for f in forms for p in f]) ** DEGREE @ self.weights
        return (np.maximum.reduceat(values, np.concatenate(([0], np.cumsum(sizes)[:-1]))) + self.offset).tolist()

    def worst(self, texts: list[list[str]]) -> tuple[np.ndarray, list[str | None]]:
        """Margin and word of each text's worst word."""
        known = self._known
        distinct = [dict.fromkeys(words) for words in texts]
        fresh = [w for w in dict.fromkeys(w for words in distinct for w in words) if w not in known]
        if len(known) + len(fresh) > _CACHE_WORDS:
            known.clear()
            fresh = list(dict.fromkeys(w for words in distinct for w in words))
        if fresh:
            known.update(zip(fresh, self.margins(fresh)))
        found = [max(words, key=known.__getitem__, default=None) for words in distinct]
        return np.array([self.offset if w is None else known[w] for w in found]), found


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 60) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    ridge = np.full(x1.shape[1], penalty * weight.sum())
    ridge[-1] *= 1e-3
    for _ in range(steps):
        active = y * (x1 @ w) < 1
        inside = x1[active]
        xa = inside * weight[active, None]
        new = np.linalg.solve(inside.T @ xa + np.diag(ridge), xa.T @ y[active])
        del inside, xa
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(toxic | margin), with smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - goal) + 0.05 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    slope = float(np.clip(w[0], 1.0, 8.0))
    shift = slope * float(w[1] / w[0]) if w[0] > 0.1 else 0.0
    return slope, float(np.clip(shift, -slope, slope))


def _starts(words: Iterable[str]) -> set[str]:
    """Marked beginnings of words, and whole words up to ``_LONGEST``."""
    found = set()
    for w in words:
        found.update(f"^{w[:n]}" for n in range(_SHORTEST, min(len(w), _LONGEST + 1) + 1))
        if _SHORTEST - 1 <= len(w) <= _LONGEST:
            found.add(f"^{w}$")
    return found


def count_documents(found: Iterable[str], toxic: Iterable[bool]) -> tuple[Counter, Counter, Counter]:
    """In how many toxic and clean documents each beginning is, and in how many clean ones each word."""
    up, down, common = Counter(), Counter(), Counter()
    for forms, bad in zip(found, toxic):
        words = set(forms.split())
        (up if bad else down).update(_starts(words))
        if not bad:
            common.update(w for w in words if len(w) >= _SHORTEST)
    return up, down, common


def gain(n: int, m: int, a: int, b: int) -> float:
    """Log-likelihood ratio of the shares n of a toxic and m of b clean documents; 0 if the clean share is not far smaller."""
    if m * a * 10 > n * b:
        return 0.0
    total = 0.0
    for k, size in ((n, a), (m, b)):
        for part, share in ((k, (n + m) / (a + b)), (size - k, 1 - (n + m) / (a + b))):
            total += part * np.log(part / size / share) if part else 0.0
    return total


def choose_landmarks(gains: dict[str, float], common: list[str], count: int) -> list[str]:
    """Beginnings by how surely they tell toxic documents, none that another one begins with, then the commonest clean words."""
    best: list[str] = []
    for w in sorted(gains, key=lambda w: (-round(gains[w], 6), -len(w), w)):
        if len(best) >= count - count // 4:
            break
        bare = w.rstrip("$")
        if not any(bare.startswith(x.rstrip("$")) or x.startswith(bare) for x in best):
            best.append(w)
    return best + [f"^{w}$" for w in common[: count // 4]]


def _disguised(word: str) -> list[str]:
    """The word with a character after one of its inner letters; to the kernel all that match nothing are one."""
    return [word[:i] + "." + word[i:] for i in range(2, len(word) - 1)]


def fit(texts: list[str | None], labels: list[int], landmarks: int = LANDMARKS, rounds: int = 4) -> ToxicityModel:
    """Model from labelled documents."""
    return fit_forms([_forms(t) for t in texts], labels, landmarks, rounds)


def _forms(text: str | None, most: int | None = None) -> str:
    """The distinct normal forms of a text's words, at most so many, with spaces between."""
    forms = list(dict.fromkeys(map(kernel.normal_form, dict.fromkeys(words_of(text)))))
    if most is not None and len(forms) > most:
        forms = sorted(forms, key=lambda w: zlib.crc32(w.encode()))[:most]
    return " ".join(forms)


def fit_forms(found: list[str], labels: list[int], landmarks: int = LANDMARKS, rounds: int = 4) -> ToxicityModel:
    """Model from the word forms of labelled documents held here."""
    toxic = [y > 0 for y in labels]
    a, b = sum(toxic), len(toxic) - sum(toxic)
    if not a or not b:
        return _one_kind(a > 0)
    up, down, common = count_documents(found, toxic)
    gains = {w: g for w, k in up.items() if k > 1 and (g := gain(k, down[w], a, b)) >= _LEAST_GAIN}
    marks = kernel.Landmarks(choose_landmarks(gains, sorted(common, key=lambda w: (-common[w], w)), landmarks) or ["^the$"])
    known = [doc for at in range(0, len(found), 64) for doc in near_landmarks(map(pieces_of, found[at : at + 64]), marks)]
    number = {p: k for k, p in enumerate(dict.fromkeys(["", *(p for pieces, _ in known for p in pieces)]))}
    known = [(sorted(pieces, key=number.get), near[sorted(range(len(pieces)), key=lambda k: number[pieces[k]])]) for pieces, near in known]

    def picked(coef: np.ndarray | None, count: int) -> tuple[np.ndarray, list[str], np.ndarray]:
        some = [(pieces[k], near[k], bad) for (pieces, near), bad in zip(known, toxic) for k in telling(near, bad, coef, count)]
        return np.array([x for _, x, _ in some]), [p for p, _, _ in some], np.array([bad for *_, bad in some])

    def tops(coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.array([(near @ coef).max() if len(near) else 0.0 for _, near in known]), np.array(toxic)

    return _learn(marks, landmarks, rounds, picked, tops)


def _one_kind(toxic: bool) -> ToxicityModel:
    return ToxicityModel(None, np.empty(0), 0.0, 0.0, 20.0 if toxic else -20.0)


def pieces_of(forms: str) -> list[str]:
    """The distinct pieces of a document's word forms in order."""
    return list(dict.fromkeys(p for f in forms.split() for p in kernel.pieces(f)))


def near_landmarks(found: Iterable[list[str]], marks: kernel.Landmarks) -> list[tuple[list[str], np.ndarray]]:
    """Of each document's pieces those that share something with a landmark, and their kernels; all others are one of zeros, the
    empty piece."""
    members = list(found)
    number: dict[str, int] = {}
    distinct = list(dict.fromkeys(p for pieces in members for p in pieces))
    kept = [np.zeros((1, len(marks.words)), dtype=np.float32)]
    for at in range(0, len(distinct), _BLOCK):
        block = marks.products(distinct[at : at + _BLOCK])
        some = np.flatnonzero(block.max(axis=1) > 0.1)
        number.update(zip([distinct[at + k] for k in some.tolist()], range(len(number) + 1, len(number) + 1 + len(some))))
        kept.append((block[some] ** DEGREE).astype(np.float32))
    near = np.concatenate(kept)
    out = []
    for pieces in members:
        own = [p for p in pieces if p in number]
        names = [""] * (len(own) < len(pieces)) + own
        out.append((names, near[[number.get(p, 0) for p in names]]))
    return out


def telling(near: np.ndarray, toxic: bool, coef: np.ndarray | None, count: int) -> np.ndarray:
    """Which pieces stand for a document: of a clean one the four worst, of a toxic one the worst and all that hold one of the
    first ``count`` landmarks whole. A toxic one without any likely piece is left out: its label says nothing about its words."""
    share = near[:, :count].max(axis=1)
    order = np.argsort(-(share if coef is None else near @ coef), kind="stable")
    if not toxic:
        return order[:4]
    best = order[:6]
    return best[(share[best] > 0.9**DEGREE) | ((np.arange(len(best)) == 0) & (share[best] > 0.5**DEGREE))]


def _learn(marks: kernel.Landmarks, landmarks: int, rounds: int, picked: Callable, tops: Callable) -> ToxicityModel:
    """Model from the pieces that ``picked`` finds to stand for the documents under the weights so far, and the documents' margins
    that ``tops`` finds under the last ones."""
    values, vectors = np.linalg.eigh(marks.gram**DEGREE)
    # K(L, L)^-1/2; directions that the landmarks hardly span are damped.
    root = vectors / np.sqrt(np.maximum(values, 0.05)) @ vectors.T
    count = max(1, len(marks.words) - min(len(marks.words), landmarks // 4))
    w = np.zeros(root.shape[1] + 1)
    fake, spans, coef = np.zeros((0, len(marks.words))), [0], None
    for _ in range(rounds):
        x, names, toxic = picked(coef, count)
        if not toxic.any():
            break
        told = sorted({n for n, bad in zip(names, toxic.tolist()) if bad})
        spellings = [_disguised(t) for t in told]
        spans = np.concatenate(([0], np.cumsum([len(s) for s in spellings if s]))).astype(int)
        plain = [d for s in spellings for d in s]
        fake = np.zeros((len(plain), len(marks.words)))
        for at in range(0, len(plain), _BLOCK):
            fake[at : at + _BLOCK] = marks.products(plain[at : at + _BLOCK]) ** DEGREE
        rows = np.concatenate((x, fake)) @ root
        target = np.concatenate((np.where(toxic, 1.0, -1.0), np.ones(len(fake))))
        weight = np.ones(len(target))
        up, real = target > 0, np.arange(len(target)) < len(x)
        weight[up & real] = (~up).sum() / 2 / max(1, (up & real).sum())
        weight[~real] = (~up).sum() / 4 / max(1, (~real).sum())
        w = _svm(rows, target, weight / len(weight), 1e-4)
        coef = root @ w[:-1]
    model = ToxicityModel(marks, root @ w[:-1], float(w[-1]), 1.0, 0.0)
    worst, toxic = tops(model.weights)
    weakest = np.minimum.reduceat(fake @ model.weights, spans[:-1]) + model.offset if len(fake) else np.empty(0)
    y = np.concatenate((np.where(toxic, 1.0, -1.0), np.ones(len(weakest))))
    model.slope, model.shift = _logistic(np.concatenate((worst + model.offset, weakest)), y)
    return model


def _training_forms(batches: Iterable[pa.RecordBatch], max_words: int) -> Iterator[pa.RecordBatch]:
    schema = schema_of(_TRAINING)
    for batch in slices(batches, 64):
        forms = [_forms(t, max_words) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms)], schema=schema)


def training_rows(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_train: int = MAX_TRAIN, label: str = "toxic", max_words: int = MAX_WORDS
) -> DataFrame:
    """``(doc_id, label, forms)`` of at most ``max_train`` labelled documents, the same ones in every run."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marks = marks if learn is None else marks.where(learn)
    marks = marks.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    chosen = marks.orderBy(F.md5(F.col("doc_id").cast("string")), "label").limit(max_train)
    # Of the rows of one id one is taken, so there are no more rows than chosen labels.
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return found.mapInArrow(lambda b: _training_forms(b, max_words), _TRAINING)


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = schema_of(_COUNTS)
    for batch in slices(batches, size=512 << 10):
        up, down, common = count_documents(batch.column(2).to_pylist(), [y > 0 for y in batch.column(1).to_pylist()])
        words = list(up | down)
        columns = [[True] * len(words) + [False] * len(common), words + list(common)]
        columns += [[up[w] for w in words] + [0] * len(common), [down[w] for w in words] + list(common.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _gains(batches: Iterable[pa.RecordBatch], a: int, b: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [gain(n, m, a, b) for n, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        gains = pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.float64())], schema=schema_of(_GAINS))
        yield gains.filter(pa.array([g >= _LEAST_GAIN for g in found], type=pa.bool_()))


def _near(batches: Iterable[pa.RecordBatch], marks: kernel.Landmarks) -> Iterator[pa.RecordBatch]:
    schema = schema_of(_NEAR)
    for batch in slices(batches):
        pieces = [p for p, _ in near_landmarks(map(pieces_of, batch.column(2).to_pylist()), marks)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, type=schema.field(2).type)], schema=schema)


def _documents(batch: pa.RecordBatch, marks: kernel.Landmarks) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """Kernels are made anew in each round: written out, they would be many times the texts."""
    doc, label, pieces = (c.to_pylist() for c in batch.columns)
    for i, y, (names, near) in zip(doc, label, near_landmarks(pieces, marks)):
        yield i, y, names, near


def _placed(near: DataFrame) -> DataFrame:
    """``near`` with its pieces in the order of their first documents, so that equal margins are told apart alike in all documents;
    the empty piece comes first."""
    own = near.select("doc_id", "label", F.posexplode_outer("pieces").alias("at", "piece"))
    first = own.where("piece IS NOT NULL").groupBy("piece").agg(F.min(F.struct("doc_id", "label", "at")).alias("first"))
    key = F.when(F.col("piece").isNotNull(), F.struct((F.col("piece") != "").alias("some"), "first", "piece"))
    placed = own.join(first, "piece", "left").groupBy("doc_id", "label").agg(F.sort_array(F.collect_list(key)).alias("keys"))
    return placed.select("doc_id", "label", F.col("keys.piece").alias("pieces"))


def _picked(batches: Iterable[pa.RecordBatch], marks: kernel.Landmarks, coef: np.ndarray | None, count: int) -> Iterator[pa.RecordBatch]:
    schema = schema_of(_PICKED)
    for batch in slices(batches):
        rows = [
            (doc, label, rank, pieces[k], near[k].tobytes())
            for doc, label, pieces, near in _documents(batch, marks)
            for rank, k in enumerate(telling(near, label > 0, coef, count).tolist())
        ]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def _tops(batches: Iterable[pa.RecordBatch], marks: kernel.Landmarks, coef: np.ndarray) -> Iterator[pa.RecordBatch]:
    schema = schema_of(_TOPS)
    for batch in slices(batches):
        margin = [float((near @ coef).max()) if len(near) else 0.0 for *_, near in _documents(batch, marks)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(margin, type=pa.float64())], schema=schema)


def fit_model(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_train: int = MAX_TRAIN) -> ToxicityModel:
    """Model from labelled documents. Words are counted and compared with the landmarks in tasks; the driver is given counts of
    telling beginnings, at most six pieces of a document and a margin for each."""
    train = stage(training_rows(docs, labels, learn, max_train), "training")
    seen = train.agg(F.count_if(F.col("label") > 0).alias("toxic"), F.count_if(F.col("label") <= 0).alias("clean")).first()
    a, b = seen["toxic"], seen["clean"]
    if not a or not b:
        return _one_kind(a > 0)
    counts = train.mapInArrow(_counts, _COUNTS).groupBy("start", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = stage(counts.where("NOT start OR toxic > 1"), "counts")
    likely = counts.where("start").where(F.col("clean") * a * 10 <= F.col("toxic") * b).select("word", "toxic", "clean")
    gains = {r["word"]: r["gain"] for r in likely.mapInArrow(lambda x: _gains(x, a, b), _GAINS).collect()}
    common = counts.where("NOT start").orderBy(F.desc("clean"), "word").limit(LANDMARKS // 4)
    marks = kernel.Landmarks(choose_landmarks(gains, [r["word"] for r in common.collect()], LANDMARKS) or ["^the$"])
    width, order = len(marks.words), [("doc_id", "ascending"), ("label", "ascending")]
    shared = docs.sparkSession.sparkContext.broadcast(marks)
    near = stage(train.repartition("doc_id").mapInArrow(lambda x: _near(x, shared.value), _NEAR), "near")
    near = stage(_placed(near), "placed")

    def picked(coef: np.ndarray | None, count: int) -> tuple[np.ndarray, list[str], np.ndarray]:
        some = near.mapInArrow(lambda x: _picked(x, shared.value, coef, count), _PICKED).toArrow().sort_by([*order, ("rank", "ascending")])
        x = np.frombuffer(b"".join(some["near"].to_pylist()), dtype=np.float32).reshape(-1, width)
        return x, some["piece"].to_pylist(), some["label"].to_numpy() > 0

    def tops(coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = near.mapInArrow(lambda x: _tops(x, shared.value, coef), _TOPS).toArrow().sort_by(order)
        return found["margin"].to_numpy(), found["label"].to_numpy() > 0

    model = _learn(marks, LANDMARKS, 4, picked, tops)
    shared.destroy()
    return model


def _score(batches: Iterable[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    schema = schema_of(SCORES)
    for batch in slices(batches):
        margin, word = model.worst([words_of(t) for t in batch.column(1).to_pylist()])
        columns = [batch.column(0), pa.array(margin), pa.array(model.score(margin)), pa.array(word, type=pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
    model.forget()


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row_id, margin, score, word)``: ``word`` is what the score rests on."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda b: _score(b, shared.value), SCORES)


def _keep(batches: Iterable[pa.RecordBatch], model: ToxicityModel, text_col: str, border: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        margin, _ = model.worst([words_of(t) for t in batch.column(text_col).to_pylist()])
        yield batch.filter(pa.array(model.score(margin) < border))
    model.forget()


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", border: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whatever columns they have, whose score is under ``border``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda b: _keep(b, shared.value, text_col, border), docs.schema)
