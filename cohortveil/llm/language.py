"""Language identification.

Sparse multinomial logistic regression on TF-IDF weighted character n-grams
(hashed), trained with follow-the-regularised-leader (FTRL-proximal) under an
elastic-net penalty, then calibrated by one temperature.

Document frequencies come from every document that may be learned from; the
weights and the temperature from a bounded sample of them.

Edge cases: a null text, or one without a letter, is ``und`` with score 0.  Rows
with a null language teach nothing.  With no language to learn, every row is
``und``.  Ties between languages go to the first by name.  Long texts count whole;
repeated rows are judged alike; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import first_by_hash, texts_of
from .textarrays import chunks, fold_table

#: Places of the hashed n-grams, and their lengths.
DIMENSIONS = 1 << 14
GRAMS = (1, 2, 3)
#: Documents per language that the weights are fitted on, at most, and the share
#: of them (in fifths) held back for the temperature.
SAMPLE_PER_LANGUAGE = 1000
HELD_FIFTHS = 1
UNDETERMINED = "und"
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (DIMENSIONS, languages)
    bias: np.ndarray
    temperature: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _gram_places(texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
    """Hashed n-grams of each text, and whether it has a letter.

    Letters and digits count in lower case, any run of other characters is one
    gap; n-grams reach over at most one gap at either end.
    """
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    folded = fold_table()[codes].astype(np.uint64)
    letters = _letters()[codes]
    at = 0
    for text in texts:
        size = len(text)
        own = folded[at:at + size]
        has = bool(letters[at:at + size].any())
        at += size + 1
        kept = np.ones(size, bool)
        kept[1:] = (own[1:] != 0) | (own[:-1] != 0)
        own = np.concatenate(([0], own[kept], [0])).astype(np.uint64)
        out = []
        for n in GRAMS:
            m = len(own) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h += (own[k:k + m] + np.uint64(k + 1)) * np.uint64(_FACTORS[k])
            h ^= h >> np.uint64(29)
            h *= np.uint64(_FACTORS[0])
            out.append((h >> np.uint64(50)).astype(np.int64))
        yield np.concatenate(out), has


def vector(places: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse unit vector of (1 + log count) · idf."""
    counts = np.bincount(places, minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((value * value).sum())
    return at, value / norm if norm else value


def document_frequency(learnable: DataFrame, text_col: str = "text") -> DataFrame:
    """(place, documents) over all rows, plus place -1 with the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for _, held in chunks(batch.column(0).to_pylist()):
                for places, _ in _gram_places(held):
                    seen += np.bincount(places, minlength=DIMENSIONS) > 0
                    rows += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.append(at, -1).astype(np.int32)),
                                          "documents": pa.array(np.append(seen[at], rows))})

    return (learnable.select(F.col(text_col)).mapInArrow(count, "place int, documents bigint")
            .groupBy("place").agg(F.sum("documents").alias("documents")))


def fit_ftrl(vectors: list, labels: np.ndarray, n_labels: int, epochs: int = 3, alpha: float = 0.5,
             beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the examples, in the order given; the last place is the bias."""
    z = np.zeros((DIMENSIONS + 1, n_labels))
    n = np.zeros((DIMENSIONS + 1, n_labels))

    def weights(at, l1=l1):
        zz, nn = z[at], n[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    for _ in range(epochs):
        for (places, values), label in zip(vectors, labels):
            at = np.append(places, DIMENSIONS)
            x = np.append(values, 1.0)
            w = weights(at)
            score = x @ w
            score -= score.max()
            p = np.exp(score)
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(DIMENSIONS + 1))
    return w[:-1], w[-1]


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of least log loss on held-back rows, by golden-section search on its log."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    low, high, ratio = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(learnable: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all given rows with a language (frequencies) and a bounded sample (weights)."""
    rows = (learnable.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                             F.col(lang_col).alias("lang")).where("lang is not null and text is not null"))
    found = {r.place: r.documents for r in document_frequency(rows).collect()}  # at most DIMENSIONS + 1 rows
    total = found.pop(-1, 0)
    df = np.zeros(DIMENSIONS)
    df[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    sample = texts_of(rows, first_by_hash(rows, "lang", F.lit(SAMPLE_PER_LANGUAGE)), "lang")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r["lang"], r["id"] or "", r["text"]) for b in batches for r in b.to_pylist())
        names = sorted({r[0] for r in got})
        index = {x: i for i, x in enumerate(names)}
        turn = np.random.default_rng(7).permutation(len(got))
        vectors, labels = [], []
        for i in turn:
            (places, has), = _gram_places([got[i][2]])
            if has:
                vectors.append(vector(places, idf))
                labels.append(index[got[i][0]])
        labels = np.array(labels, np.int64)
        held = np.arange(len(labels)) % 5 < HELD_FIFTHS
        w, b = fit_ftrl([v for v, h in zip(vectors, held) if not h], labels[~held], len(names))
        scores = np.array([x @ w[at] + b for (at, x), h in zip(vectors, held) if h]).reshape(-1, len(names))
        t = fit_temperature(scores, labels[held]) if len(names) else 1.0
        yield pa.RecordBatch.from_pydict(
            {"names": pa.array([names], pa.list_(pa.string())), "weights": pa.array([w.tobytes()], pa.binary()),
             "bias": pa.array([b.tobytes()], pa.binary()), "temperature": pa.array([t], pa.float64())})

    fitted = sample.mapInArrow(
        fit, "names array<string>, weights binary, bias binary, temperature double").collect()
    if not fitted:  # an empty table may have no task at all
        return Model([], idf, np.zeros((DIMENSIONS, 0)), np.zeros(0), 1.0)
    row = fitted[0]
    names = list(row.names)
    return Model(names, idf, np.frombuffer(bytes(row.weights)).reshape(DIMENSIONS, len(names)),
                 np.frombuffer(bytes(row.bias)), row.temperature)


def predict(documents: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred",
            score_col: str = "score") -> DataFrame:
    """All columns plus the predicted language and its calibrated probability."""
    if {lang_col, score_col} & set(documents.columns):
        raise ValueError(f"{lang_col} or {score_col} exists already; name other columns")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            for _, held in chunks(batch.column(text_col).to_pylist()):
                for places, has in _gram_places(held):
                    if not has or not m.languages:
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    at, x = vector(places, m.idf)
                    s = (x @ m.weights[at] + m.bias) / m.temperature
                    best = int(s.argmax())
                    langs.append(m.languages[best])
                    scores.append(float(1 / np.exp(s - s[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, lang_col, score_col])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(lang_col, T.StringType()),
                                                   T.StructField(score_col, T.DoubleType())]))
