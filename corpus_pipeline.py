"""A training corpus from ``documents``: language ID, near-duplicate removal, decontamination, mixing and sharding.

Each stage is one operator of ``awardsift.llm`` applied to all that its predecessor kept; its rows are written as Parquet
and read again before the next stage begins, so a lost executor never costs more than the stage it was in. All stages
but the last return the columns of ``documents``; the last adds ``shard`` and ``slot``.

No SQL stands beside it: the first stage keeps what a learned language model accepts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from awardsift.llm.data import folder, table
from awardsift.llm.decontaminate import remove_documents
from awardsift.llm.jaccard import one_of_each
from awardsift.llm.langid import identified
from awardsift.llm.mixing import sample
from awardsift.llm.sharding import interleave


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and dominant."""
    return identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group joined by links."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no considerable part of the benchmark."""
    return remove_documents(spark, docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that their tokens have the target shares."""
    return sample(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, dealt to shards that each have the mixture of the whole."""
    return interleave(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
