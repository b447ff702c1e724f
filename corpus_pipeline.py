"""A corpus pipeline of five stages: quality rules, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows and rereads them for the next.
All but the last return the columns of documents. Mixing may return a document up to three times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiweft.llm._common import materialize
from lexiweft.llm.bpe import bpe_digests
from lexiweft.llm.mixing import mixed_documents
from lexiweft.llm.neardup import drop_near_duplicates
from lexiweft.llm.quality import keep_good
from lexiweft.llm.secretscan import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and are no outliers of their language and source."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, size=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in them masked."""
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of ids and decoded text, a row for each row of the mix."""
    return bpe_digests(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: Trained classifiers and pseudorandom permutations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
