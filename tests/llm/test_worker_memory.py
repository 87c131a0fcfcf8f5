"""What goes to a Python worker at once, comes back at once, and is remembered there."""

import types

import pyarrow as pa

from deedlink.llm import byte_pairs, common

RANKS = {bytes([b]): b for b in range(256)} | {b"ab": 256}


def test_long_texts_travel_in_bounded_batches(spark):
    rows = spark.range(12).selectExpr("id doc_id", "repeat('x', 1 << 20) text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    got = [r.n for r in common.map_arrow(rows, sizes, "n long").collect()]
    assert sum(got) == 12 and max(got) <= 3
    assert int(spark.conf.get(common.BATCH_SETTING)) == common.BATCH_BYTES


def test_a_worker_hands_tokens_over_as_it_goes():
    spark = types.SimpleNamespace(sparkContext=types.SimpleNamespace(broadcast=lambda v: types.SimpleNamespace(value=v)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": ["c" * (byte_pairs.HELD_TOKENS // 2)] * 8 + [None]})
    out = list(byte_pairs._runner(spark, RANKS, r"\w+", ["ids", "n_tokens"], 100)(iter([batch])))
    assert [b.num_rows for b in out] == [2, 2, 2, 2, 1]
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(9))
    assert out[-1].column("ids").to_pylist() == [[]]


def test_hashes_of_words_go_with_their_operator():
    common.forget_others("one")
    common.word_hashes(["a", "b"])
    common.forget_others("one")
    assert common._word_hashes
    common.forget_others("two")
    assert not common._word_hashes
