import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import WITHOUT_ID, documents, nothing, rows, texts, words
from wellspark.llm import kernel, quality, toxicity

INSULTS = ["blaggard", "nitwit", "dunce"]


def labelled(n=240, seed=0):
    rng = random.Random(seed)
    found = []
    for i in range(n):
        own = words(1000 + i, 60)
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                own[rng.randrange(60)] = rng.choice(INSULTS)
        junk = i % 3 == 0
        if junk:
            own = [w + rng.choice(["&&&", "%%%"]) for w in own] if i % 2 else [w for w in own[:10] for _ in range(6)]
        found.append((i, " ".join(own), int(not junk), int(toxic)))
    return found


@pytest.fixture(scope="module")
def trained():
    train = labelled()
    return toxicity.fit([t for _, t, _, _ in train], [y for _, _, _, y in train])


def test_kernel_is_the_sum_over_subsequences():
    def brute(a, b):
        def features(w):
            found = {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, len(w)):
                        if k - i < kernel.SPAN:
                            key = w[i] + w[j] + w[k]
                            found[key] = found.get(key, 0) + kernel.DECAY ** (k - i + 1)
            return found

        x, y = features(a), features(b)
        return sum(v * y.get(k, 0) for k, v in x.items())

    marks = kernel.Landmarks(["^idiot$", "^clown", "^aba$"])
    for w in ["^idiot$", "^idxiot$", "^clowns$", "^ababa$", "^zzz$"]:
        want = [min(1.0, brute(w, m) / brute(m, m)) for m in marks.words]
        np.testing.assert_allclose(marks.products([w])[0], want)


def test_long_words_are_covered():
    parts = kernel.pieces("a" * 300)
    assert all(len(p) <= kernel.MAX_CHARS for p in parts)
    assert sum(map(len, parts)) >= 302 and parts[0][0] == "^" and parts[-1][-1] == "$"


def test_toxic_words_and_disguises(trained):
    fresh = [t for _, t, _, y in labelled(200, 5) if y == 0]
    margin, _ = trained.worst([toxicity.words_of(t) for t in fresh])
    assert (trained.score(margin) < 0.5).mean() > 0.98
    plain = " ".join(words(77, 30))
    for bad in ["Blaggard!", "nitwit###", "n.i.t.w.i.t", "b l a g g a r d", "dun-ce", "DUNCE", "blagxgard", "blagggard"]:
        margin, _ = trained.worst([toxicity.words_of(f"{plain} {bad} {plain}")])
        assert trained.score(margin)[0] >= 0.5, bad


def test_toxicity_scores(spark, trained):
    docs = documents(spark, [WITHOUT_ID, rows()[0]])
    found = toxicity.score_documents(docs, trained).collect()
    assert len(found) == len(texts()) + 2
    assert all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in found if r["row_id"] in (1, 2, 3)} == {float(trained.score(np.array([trained.offset]))[0])}
    kept = toxicity.keep_clean(docs, trained)
    assert kept.schema == docs.schema and kept.count() == sum(r["score"] < 0.5 for r in found)
    assert toxicity.score_documents(nothing(spark), trained).count() == 0


def test_training_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in labelled()], "doc_id bigint, text string")
    marks = [(i, q, y) for i, _, q, y in labelled()] + [(None, 1, 1), (3, None, None)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit_model(docs, labels, F.col("doc_id") % 5 != 0)
    again = toxicity.fit_model(docs.repartition(3), labels.repartition(2), F.col("doc_id") % 5 != 0)
    np.testing.assert_array_equal(model.weights, again.weights)
    held = toxicity.score_documents(docs.where("doc_id % 5 = 0"), model).collect()
    truth = {i: y for i, _, _, y in labelled()}
    assert np.mean([(r["score"] >= 0.5) == truth[r["row_id"]] for r in held]) > 0.95
    for value in (0, 1):
        only = toxicity.fit_model(docs, labels.where(F.col("toxic") == value))
        assert {r["score"] >= 0.5 for r in toxicity.score_documents(docs, only).collect()} == {bool(value)}
    empty = toxicity.fit_model(docs, labels.where("toxic > 5"))
    assert toxicity.score_documents(docs, empty).where("score >= 0.5").count() == 0
    ranked = quality.fit_model(docs, labels, F.col("doc_id") % 5 != 0)
    held = quality.score_documents(docs.where("doc_id % 5 = 0"), ranked).collect()
    good = {i: q for i, _, q, _ in labelled()}
    assert np.mean([(r["score"] >= 0.5) == good[r["row_id"]] for r in held]) > 0.95
    assert quality.score_documents(docs, quality.fit_model(docs, labels.where("quality = 1"))).where("score < 0.5").count() == 0
    assert quality.score_documents(docs, quality.fit_model(docs, labels.where("quality > 5"))).count() == docs.count()


def test_training_compares_words_in_tasks(spark, monkeypatch):
    """The driver compares disguises of the chosen words with the landmarks, not the training documents' words; the model is the same."""
    compared, products = [0], kernel.Landmarks.products

    def counted(self, words, *more):
        compared[0] += len(words)
        return products(self, words, *more)

    found = [(i, t + " " + " ".join(f"{w}q{i}" for w in words(i, 40)), y) for i, t, _, y in labelled()]
    docs = spark.createDataFrame([(i, t) for i, t, _ in found], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in found], "doc_id bigint, toxic int")
    here = toxicity.fit([t for _, t, _ in found], [y for *_, y in found])
    monkeypatch.setattr(kernel.Landmarks, "products", counted)
    model = toxicity.fit_model(docs, labels)
    assert compared[0] < 2000 < len({w for _, t, _ in found for w in t.split()}), compared
    assert model.landmarks.words == here.landmarks.words
    np.testing.assert_allclose(model.weights, here.weights, rtol=1e-9)
    np.testing.assert_allclose([model.offset, model.slope, model.shift], [here.offset, here.slope, here.shift], rtol=1e-9)


def test_quality_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, len(quality.FEATURES)))
    model = quality.fit(x, (x[:, 0] > 0).astype(int))
    found = quality.score_documents(documents(spark, [WITHOUT_ID, rows()[0]]), model).collect()
    assert len(found) == len(texts()) + 2 and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["row_id"] in (1, 2)}) == 1
    assert quality.score_documents(nothing(spark), model).count() == 0


def test_ranking_follows_the_preferences():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, len(quality.FEATURES)))
    worth = x[:, 0] - 2 * x[:, 3]
    model = quality.fit(x, (worth + 0.3 * rng.standard_normal(2000) > 0.8).astype(int))
    score = model.score(x)
    assert np.corrcoef(np.argsort(np.argsort(score)), np.argsort(np.argsort(worth)))[0, 1] > 0.9
    assert abs((score >= 0.5).mean() - (worth > 0.8).mean()) < 0.03


def test_features_by_hand():
    row = dict(zip(quality.FEATURES, quality.text_features([b"The cat cat sat!! ok&&&\nNO 12", b"", b" \t"])[0]))
    assert row["capital_words"] == pytest.approx(1 / 7) and row["repeated_next"] == pytest.approx(1 / 7)
    assert row["junk_endings"] == pytest.approx(2 / 7) and row["bare_words"] == pytest.approx(1 / 7)
    assert row["distinct_words"] == pytest.approx(6 / 7) and row["lines"] == pytest.approx(1 / 7)
    assert row["symbols"] == pytest.approx(5 / 23)
