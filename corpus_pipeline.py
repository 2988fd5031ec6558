"""The corpus pipeline: ``run(spark, sf_dir)`` takes ``documents`` through STAGES.

Each stage works on all rows that the one before kept; every result is written as Parquet in the
shared folder and read again. All but the last return the columns of ``documents``. Stages decide by
texts, so rows without doc_id, or with that of another, are rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ontoloom.llm import decontamination, exact_dedup, packing, queries, simhash, toxicity
from ontoloom.llm.shared import new_folder, without_texts


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.3 or more go."""
    return toxicity.without_toxic(docs, queries.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (white space aside) one stays."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints the one with the smallest doc_id stays, one without
    doc_id only where all are."""
    return without_texts(docs, simhash.near_copies(docs), "near-copies")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is inside benchmark passages go."""
    return without_texts(docs, decontamination.leaking_texts(docs, queries.table(spark, sf_dir, "benchmark")), "leaks")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut and packed into sequences of 1024 tokens."""
    return packing.best_fit_packing(docs, queries.BYTE_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Fingerprints, k nearest neighbours and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
