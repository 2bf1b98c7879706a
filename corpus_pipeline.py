"""Corpus pipeline: language ID, near duplicates, decontamination, secrets, encoding.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir)
and returns a DataFrame, written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fumikura.llm import bpe, decontam, jaccard, langid, secrets
from fumikura.llm.queries import QUERIES, vocabulary
from fumikura.session import scratch_path, stages

#: Documents of which a larger share is benchmark text are dropped, others only lose the passages.
COVERAGE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that was learned: null, empty or letterless text.

    ``lang`` becomes the predicted language.
    """
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word n-grams have a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages; drops documents that mostly consist of them."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), coverage=COVERAGE)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets, and weak parts linked to others, by a mark."""
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """<doc_id, lang, n_tokens, ids, ids_sha256, decoded_sha256> of every document left."""
    keep = tuple(c for c in ("doc_id", "lang") if c in docs.columns)
    return bpe.encode_documents(docs, vocabulary(), keep)


STAGES = [
    ("language_id", languages),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_codec", encoding),
]

#: Learned trees, components and merges are not expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with stages(spark):  # what a stage writes for itself goes when it is done
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES["pipeline"] = run
