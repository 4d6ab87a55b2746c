"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence scores p = sigmoid(b + sum of the
weights of its words and word beginnings); a document scores the noisy-or
1 - prod(1 - p).  Only document labels are needed to train; the sentences' own
scores then locate what is offensive.

Edge cases: a null or empty text, and one without words, has no sentences and
scores 0.  Very long texts are scored whole, sentence by sentence.  Repeated rows
are scored alike.  Without labelled rows of both kinds the model scores 0.
Columns other than the named ones are never read.
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
from .textarrays import Words, chunks, mix

#: Places of the hashed weight table.
DIMENSIONS = 1 << 20
#: Lengths of the word beginnings that count beside whole words.
PREFIXES = (4, 5, 6)
#: Labelled documents learned from, at most, of each class (bounds the training task).
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
#: Features in fewer sampled documents than this keep the weight 0.
LEAST_DOCUMENTS = 5
#: A sentence at or over this is reported as offending.
SENTENCE_THRESHOLD = 0.5
_ENDS = ".!?\n。！？…"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


@lru_cache(maxsize=1)
def _ends_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[0, *map(ord, _ENDS)]] = True
    return table


@dataclass
class Sentences:
    """Sentences of a chunk and their features (one array per kind of feature)."""

    document: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    features: list[tuple[np.ndarray, np.ndarray]]  # (sentence, place in the weight table)

    def logits(self, model: Model) -> np.ndarray:
        z = np.full(len(self.document), model.bias)
        for sentence, place in self.features:
            z += np.bincount(sentence, model.weights[place], len(z))
        return z


def sentences(texts: list[str]) -> Sentences:
    """Split texts at sentence ends and line ends; sentences without words are left out."""
    words = Words(texts)
    text = words.text_of()
    if not len(text):
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, [])
    ends = np.cumsum(_ends_table()[words.codes])[words.begin]
    new = np.ones(len(text), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (text[1:] != text[:-1])
    sentence = np.cumsum(new) - 1
    last = np.append(np.flatnonzero(new)[1:] - 1, len(text) - 1)
    mask = np.uint64(DIMENSIONS - 1)
    # a word right after itself says nothing new
    fresh = new.copy()
    fresh[1:] |= words.hash[1:] != words.hash[:-1]
    own = np.flatnonzero(fresh)
    features = [(sentence[own], (words.hash[own] & mask).astype(np.int32))]
    length = words.end - words.begin
    for size in PREFIXES:
        has = np.flatnonzero(fresh & (length >= size))
        head = words.span_hash(words.begin[has], words.begin[has] + size)
        features.append((sentence[has], (mix(head + np.uint64(size)) & mask).astype(np.int32)))
    return Sentences(text[new], words.begin[new] - words.base[text[new]],
                     words.end[last] - words.base[text[last]], features)


def _document_log_clean(logits: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    """log prod(1 - p) of every document; log(1 - sigmoid(z)) = -log(1 + e^z)."""
    return -np.bincount(document, np.logaddexp(0.0, logits), n)


def fit_bags(texts: list[str], toxic: np.ndarray, steps: int = 160, rate: float = 0.2,
             lasso: float = 3e-4) -> Model:
    """Minimise the documents' log loss under noisy-or plus an L1 penalty (Adam, proximal steps).

    Rare features are set aside first and the penalty keeps most weights at 0, so
    a sentence is judged by the few features that tell the classes apart.
    """
    if not len(texts) or toxic.all() or not toxic.any():
        return Model(np.zeros(DIMENSIONS, np.float32), -50.0)
    documents, parts, sentence_count = [], [], 0
    for at, held in chunks(texts):
        s = sentences(held)
        documents.append(s.document + at)
        parts += [(sentence + sentence_count, place) for sentence, place in s.features]
        sentence_count += len(s.document)
    document = np.concatenate(documents)
    sentence, place = (np.concatenate(x) for x in zip(*parts))
    seen = np.unique(document[sentence].astype(np.int64) * DIMENSIONS + place) % DIMENSIONS
    kept = np.flatnonzero(np.bincount(seen, minlength=DIMENSIONS) >= LEAST_DOCUMENTS)
    column = np.full(DIMENSIONS, -1, np.int32)
    column[kept] = np.arange(len(kept))
    column = column[place]
    sentence, column = sentence[column >= 0], column[column >= 0]
    n, width = len(texts), len(kept)
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    weights, bias = np.zeros(width), -4.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.clip(bias + np.bincount(sentence, weights[column], sentence_count), -60, 60)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(_document_log_clean(z, document, n))
        pull = np.where(toxic, -clean / np.maximum(1 - clean, 1e-9), 1.0) * share
        g = p * pull[document]
        gw, gb = np.bincount(column, g[sentence], width), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix1, fix2 = 1 - 0.9 ** step, np.sqrt(1 - 0.99 ** step)
        pace = rate / (np.sqrt(v) / fix2 + 1e-4)
        weights -= pace * m / fix1
        weights = np.sign(weights) * np.maximum(np.abs(weights) - pace * lasso, 0)
        bias -= rate * mb / fix1 / (np.sqrt(vb) / fix2 + 1e-4)
    full = np.zeros(DIMENSIONS, np.float32)
    full[kept] = weights
    return Model(full, float(bias))


def labelled_sample(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic") -> DataFrame:
    """The bounded training sample: the first rows of each class in an order by hash of the id.

    Labels null or other than 0 and 1 teach nothing; an id labelled twice counts
    as toxic if any label says so.
    """
    label = F.col(label_col).cast("int")
    wanted = (labels.select(F.col(id_col).alias("id"), label.alias("toxic"))
              .where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic")))
    known = documents.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    limit = F.when(F.col("toxic") == 1, SAMPLE_TOXIC).otherwise(SAMPLE_CLEAN)
    chosen = first_by_hash(wanted.join(known, "id", "left_semi"), "toxic", limit)
    return texts_of(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), chosen, "toxic")


def train(sample: DataFrame) -> Model:
    """Fit in one task on the bounded sample (columns id, toxic, text; one partition)."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["id"], r["toxic"], r["text"] or "") for b in batches for r in b.to_pylist())
        model = fit_bags([r[2] for r in rows], np.array([r[1] == 1 for r in rows], bool))
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "bias": [model.bias]},
                                         pa.schema([("weights", pa.binary()), ("bias", pa.float64())]))

    rows = sample.mapInArrow(fit, "weights binary, bias double").collect()
    if not rows:  # an empty table may have no task at all
        return fit_bags([], np.zeros(0, bool))
    row = rows[0]
    return Model(np.frombuffer(bytes(row.weights), np.float32), row.bias)


def score(documents: DataFrame, model: Model, text_col: str = "text", score_col: str = "score",
          offending_col: str = "offending") -> DataFrame:
    """All columns plus the document's score and its offending sentences.

    The two new columns must not exist yet; spans are code points of the text.
    """
    if {score_col, offending_col} & set(documents.columns):
        raise ValueError(f"{score_col} or {offending_col} exists already; name other columns")
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            scores = np.zeros(len(texts))
            spans: list[list] = [[] for _ in texts]
            for at, some in chunks(texts):
                s = sentences(some)
                z = s.logits(held)
                scores[at:at + len(some)] = -np.expm1(_document_log_clean(z, s.document, len(some)))
                p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                for i in np.flatnonzero(p >= SENTENCE_THRESHOLD):
                    spans[at + s.document[i]].append({"start": int(s.start[i]), "length": int(s.stop[i] - s.start[i]),
                                                      "score": float(p[i])})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.clip(scores, 0.0, 1.0)), pa.array(spans, kind)],
                names=[*batch.schema.names, score_col, offending_col])

    span = T.StructType().add("start", "integer").add("length", "integer").add("score", "double")
    schema = T.StructType([*documents.schema.fields, T.StructField(score_col, T.DoubleType()),
                           T.StructField(offending_col, T.ArrayType(span))])
    return documents.mapInArrow(run, schema)
