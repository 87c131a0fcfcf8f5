"""The pipeline's stages one after the other."""

import importlib.util

import pytest
from samples import ODD
from pyspark.sql import functions as F

from deedlink.llm import compression_quality as cq, containment, jaccard_join, line_dedup
from deedlink.llm.common import stage

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is not here", allow_module_level=True)
import corpus_pipeline as cp  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_takes_effect(spark, small):
    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, function in cp.STAGES[:-1]:
        before = docs
        docs = stage(function(spark, docs, small), f"test-{name}")
        assert docs.columns == COLUMNS
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert set(kept[name]) <= {r.doc_id for r in before.select("doc_id").collect()}
    rejected = {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").collect()} - set(kept["quality"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert rejected and sum(labels.get(i, 0) == 1 for i in rejected) <= 3
    # no line of some length occurs twice any more
    lines = [x for r in kept["lines"].values() for x in r.text.split("\n") if len(x) >= line_dedup.MIN_DROPPED_CHARS]
    assert len(lines) == len(set(lines)) and set(kept["lines"]) == set(kept["quality"])
    # no links and no test items are left
    left = spark.createDataFrame([(r.doc_id, r.text) for r in kept["decontamination"].values()], "doc_id long, text string")
    assert jaccard_join.jaccard_join(left).where("n_links > 0").isEmpty()
    assert containment.contained_items(left, spark.read.parquet(f"{small}/benchmark.parquet")).isEmpty()
    last = {r.doc_id: r for r in cp.STAGES[-1][1](spark, docs, small).collect()}
    assert set(last) == set(kept["decontamination"])
    got = {r.doc_id: r.ids_sha256 for r in cp.run(spark, small).collect()}
    assert got == {i: r.ids_sha256 for i, r in last.items()}


def test_odd_and_empty_documents(spark, small, odd, empty):
    for docs, rows in ((odd, len(ODD)), (empty, 0)):
        for name, function in cp.STAGES:
            out = function(spark, docs, small)
            assert out.count() <= rows
            if name != cp.STAGES[-1][0]:
                assert out.columns == docs.columns


def test_good_documents_are_those_the_classifier_keeps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = cq.fit(docs, spark.read.parquet(f"{small}/labels.parquet"), cq.fold(F.col("doc_id")) != 2)
    want = {r.doc_id for r in cq.score(docs, model, "s").where("s >= 0.7").collect()}
    assert {r.doc_id for r in cp.STAGES[0][1](spark, docs, small).collect()} == want


def test_workers_forget_the_transducer(spark):
    """A worker that turns to another operator gives up what encoding has left in it."""
    from deedlink.llm import byte_pairs
    from deedlink.llm.common import map_arrow

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256}
    one = spark.createDataFrame([(1, "abba")], "doc_id long, text string").coalesce(1)

    def left(batches):
        import pyarrow as pa

        from deedlink.llm import byte_pairs

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(byte_pairs._loaded)] * batch.num_rows, pa.int64())], ["n"])

    for _ in range(3):
        assert byte_pairs.tokens(one, ranks, r"\w+", ["n_tokens"]).collect()[0].n_tokens == 3
        assert map_arrow(one, left, "n long").collect()[0].n == 0
