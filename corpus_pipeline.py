"""Corpus pipeline: toxic documents go, repeated lines go, one of each group of near
copies stays, benchmark leaks go, and what is left is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.  Rows of any source pass;
columns of ``documents`` are kept, and others are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortveil.llm import decontaminate, jaccard_join, line_spread, packing, toxicity
from cohortveil.llm.queries import fold, table
from cohortveil.session import cut, small_batches, tune

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document at or over this score is rejected.
TOXIC_SCORE = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring under ``TOXIC_SCORE``; the model learns from labelled documents not held out."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels").where(fold(3) != 1)))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC_SCORE).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines; every document stays, ``n_chars`` follows its text."""
    cleaned = line_spread.clean(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of every class of near copies."""
    return jaccard_join.keep_one(docs).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs)


def _staged(stage):
    """The stage in a session that hands texts to Python workers in small batches."""
    return lambda spark, docs, sf_dir: stage(small_batches(spark), docs, sf_dir)


STAGES = [(name, _staged(stage)) for name, stage in (
    ("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks), ("packing", pack))]

#: Training, edit distance and packing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = table(tune(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
