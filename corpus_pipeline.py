"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns
its documents with the columns of ``documents``; the last one returns the places of the
pieces in their sequences. SQL cannot express language profiles or tokens, so the
result is tested against brute force (tests/llm/test_pipeline.py).

Defined cases: rows with a null, empty or letterless text are rejected by the first
stage; rows with a null key stay, each by itself; of repeated rows one stays; rows with
equal keys and different texts are documents of their own; texts of any length are read
whole; an empty table gives no rows; further columns, whatever they are called, pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, langid, nearjoin, packing, queries, secretscan
from tidemark.llm.runtime import materialize

#: Documents without letters, or hardly nearer to any language than to none, are rejected.
LEAST_LANGUAGE_SCORE = 0.02


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs, queries.language_prototypes(docs), least=LEAST_LANGUAGE_SCORE)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearjoin.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("best-fit packing", packed),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
