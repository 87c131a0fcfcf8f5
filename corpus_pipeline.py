"""From raw documents to tokens: quality, repeated lines, near duplicates, leaked test items, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from deedlink.llm import byte_pairs, compression_quality, containment, jaccard_join, line_dedup
from deedlink.llm.common import stage
from deedlink.llm.queries import GOOD_SCORE, table, vocabulary

#: States of the byte-pair transducer that a worker remembers: few, since the executors' heaps are full after the stages before.
WORKER_STATES = 20_000


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good."""
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels"), compression_quality.fold(F.col("doc_id")) != 2)
    scored = compression_quality.score(docs, model, "_score")
    return scored.where(F.col("_score") >= GOOD_SCORE).drop("_score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that nearly equal an earlier one."""
    return line_dedup.without_repeated_lines(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    return containment.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document that is left, and the digests of its ids and of what they decode to."""
    return byte_pairs.tokens(docs, *vocabulary(spark), ["ids", "n_tokens", "ids_sha256", "decoded_sha256"], states=WORKER_STATES)


STAGES = [("quality", good), ("lines", lines), ("near_duplicates", distinct), ("decontamination", clean), ("byte_pairs", encoded)]

#: The stages can't be written in SQL: trained compression dictionaries, MinHash, merges by rank.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
