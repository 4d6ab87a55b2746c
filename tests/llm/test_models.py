"""Toxicity and language models: held-out accuracy, exact scoring, odd inputs."""

import random
import zlib

import numpy as np
import pytest

from cohortveil.llm import language as L
from cohortveil.llm import queries as Q
from cohortveil.llm import toxicity as X
from tests.llm.conftest import DOCS, words

SF = "/root/testdata/sf0.01"


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_toxicity_on_held_out_documents(spark):
    rows = Q.QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    caught = sum(p and t for p, t in held) / sum(t for _, t in held)
    wrong = sum(p and not t for p, t in held) / sum(not t for _, t in held)
    assert caught > 0.87 and wrong < 0.005, (caught, wrong)


def test_offending_sentences_are_located(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for d in range(400):
        sentences = [" ".join(words(rng, 8)).capitalize() for _ in range(rng.randrange(1, 12))]
        if d % 3 == 0:
            sentences[rng.randrange(len(sentences))] += " Schürke now"
        docs.append((d, ". ".join(sentences) + "."))
        labels.append((d, int(d % 3 == 0)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    model = X.train(X.labelled_sample(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    for r in X.score(docs, model).collect():
        found = [r.text[o.start:o.start + o.length] for o in r.offending]
        assert (r.score >= 0.7) == (r.doc_id % 3 == 0)
        assert all("schürke" in f.lower() for f in found) and bool(found) == (r.doc_id % 3 == 0)


def test_noisy_or_is_exact():
    texts = ["One bad. Two good\nthree", "", "four"]
    s = X.sentences(texts)
    model = X.Model(np.random.default_rng(1).normal(0, 1, X.DIMENSIONS).astype(np.float32), -0.5)
    p = 1 / (1 + np.exp(-s.logits(model)))
    assert s.document.tolist() == [0, 0, 0, 2]
    want = [1 - np.prod(1 - p[:3]), 0.0, p[3]]
    assert -np.expm1(X._document_log_clean(s.logits(model), s.document, 3)) == pytest.approx(want)


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (None, 1), (4, None), (5, 7), (99, 1)], "doc_id long, toxic int")
    model = X.train(X.labelled_sample(odd_documents, labels))
    rows = X.score(odd_documents, model).collect()
    assert len(rows) == 11 and all(r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert [f.name for f in X.score(odd_documents, model).schema.fields][:-2] == odd_documents.columns
    nothing = X.train(X.labelled_sample(no_documents, labels.limit(0)))
    assert X.score(no_documents, nothing).count() == 0
    assert {r.score < 1e-9 for r in X.score(odd_documents, nothing).collect()} == {True}
    with pytest.raises(ValueError):
        X.score(odd_documents, model, score_col="label")


def test_language_on_held_out_documents(spark):
    rows = Q.QUERIES["op9_language"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    right = [r.lang_pred == truth[r.doc_id] for r in held]
    assert np.mean(right) > 0.97
    # calibration: the mean score is near the accuracy
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.05


def test_document_frequencies_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    got = {r.place: r.documents for r in L.document_frequency(docs).collect()}
    want = np.zeros(L.DIMENSIONS, int)
    texts = [r.text for r in docs.collect()]
    for text in texts:
        (places, _), = L._gram_places([text])
        want[sorted(set(places.tolist()))] += 1
    assert got.pop(-1) == len(texts) and got == {i: int(n) for i, n in enumerate(want) if n}


def test_language_of_odd_documents(spark, odd_documents, no_documents):
    model = L.train(odd_documents)
    rows = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(odd_documents, model).select("doc_id", "lang_pred", "score").collect()}
    assert rows[2] == rows[3] == rows[4] == ("und", 0.0) and rows[5][0] == "en"
    nothing = L.train(no_documents)
    assert {r.lang_pred for r in L.predict(odd_documents, nothing).collect()} == {"und"}
    assert L.predict(no_documents, model).count() == 0


def test_temperature_softens_overconfident_scores():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 3000)
    logits = rng.normal(0, 1, (3000, 3))
    logits[np.arange(3000), labels] += 1
    assert L.fit_temperature(logits * 8, labels) > 4 * L.fit_temperature(logits, labels) > 0


def test_ftrl_leaves_weights_at_zero():
    rng = np.random.default_rng(0)
    vectors = [(np.array([i % 2, 2 + i % 50]), np.array([0.9, 0.4])) for i in range(400)]
    w, _ = L.fit_ftrl(vectors, np.array([i % 2 for i in range(400)]), 2, l1=1.0)
    assert w[0, 0] > 0 > w[1, 0] and (w[60:] == 0).all() and (w[2:52] == 0).mean() > 0.9 and DOCS and rng
