"""Registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from deedlink.llm import (
    byte_pairs,
    capture_index,
    compression_quality,
    containment,
    conversation_repair,
    isolation_rules,
    jaccard_join,
    licence_paragraphs,
    line_dedup,
    residue_negatives,
    secret_scan,
    shards,
    trie_owners,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Score from which a document counts as good.
GOOD_SCORE = 0.7


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(spark: SparkSession) -> tuple[dict[bytes, int], str]:
    """Ranks and piece pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return byte_pairs.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@query
def op1_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    rows = shards.kd_shards(table(spark, folder, "documents"), ["n_chars", "source", "lang", "doc_id"], shards=40)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op2_capture_index(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives and read back through their index."""
    return capture_index.captures(table(spark, folder, "pages"))


SQL["op2_capture_index"] = capture_index.CAPTURES_SQL


@query
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its class of near duplicates and its number of links."""
    return jaccard_join.jaccard_join(table(spark, folder, "documents"))


@query
def op4_isolation_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule statistics of every document and the forest's verdict."""
    rows = isolation_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rows.select("doc_id", *isolation_rules.STATISTICS, "base_failed", "kept", "anomaly")


@query
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: counts by pattern, hash of the pattern spans, all spans."""
    documents = table(spark, folder, "documents")
    return secret_scan.with_digests(secret_scan.scan(documents, secret_scan.dictionary_of(documents)))


@query
def op6_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document by a classifier that has not seen the held-out rows."""
    documents = table(spark, folder, "documents")
    part = compression_quality.fold(F.col("doc_id"))
    model = compression_quality.fit(documents, table(spark, folder, "labels"), part != 2)
    scored = compression_quality.score(documents.select("doc_id", "text"), model, "score")
    return scored.select(
        "doc_id", (part == 2).alias("held_out"), "score", (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted")
    )


@query
def op7_licence_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Licence families of every document's paragraphs."""
    return licence_paragraphs.licences(table(spark, folder, "documents"))


@query
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document with its class of near-equal lines and whether it stays."""
    return line_dedup.line_classes(table(spark, folder, "documents"))


@query
def op9_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document by the public byte-level ranks, and the text decoded from them."""
    return byte_pairs.token_digests(table(spark, folder, "documents"), *vocabulary(spark))


@query
def op10_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and test item that it contains."""
    return containment.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op11_trie_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the row that stays of its group of equal texts."""
    return trie_owners.owners(table(spark, folder, "documents"))


SQL["op11_trie_owners"] = trie_owners.OWNERS_SQL


@query
def op12_residue_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector and its positives, some labels moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", label)
    return residue_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


SQL["op12_residue_negatives"] = residue_negatives.NEGATIVES_SQL


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every damaged conversation's faults and its cheapest repair."""
    conversations = table(spark, folder, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(conversations), conversations)
