import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deedlink.operators import aggregates as a
from deedlink.operators.ordering import fragment_of, with_fragment, with_group_position, with_position


def test_learned_label_prefers_count_then_first_seen(spark):
    rows = [("k", "x", 3), ("k", "y", 1), ("k", "y", 9), ("k", "x", 4), ("m", "z", 2), ("m", "q", 5)]
    df = spark.createDataFrame(rows, "k string, label string, ord long")
    assert {r.k: r.label for r in a.learned_label(df, ["k"], "label", "ord").collect()} == {"k": "y", "m": "z"}


def test_best_record_first_among_equals(spark):
    df = spark.createDataFrame([("k", 5, 2, "b"), ("k", 5, 1, "a"), ("k", 4, 0, "c")], "k string, v int, ord long, t string")
    assert a.best_record(df, ["k"], "v", "ord").first().t == "a"


def test_edges_and_first_present(spark):
    df = spark.createDataFrame([("k", "", 0, 1), ("k", "b", 0, 2), ("k", "c", 7, 3)], "k string, s string, n int, ord long")
    assert a.first_value(df, ["k"], ["s"], "ord").first().s == ""
    assert a.last_value(df, ["k"], ["s"], "ord").first().s == "c"
    assert tuple(a.first_present(df, ["k"], ["s", "n"], "ord").first()) == ("k", "b", 7)


def test_unique_value(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), ("c", None)], "k string, v string")
    assert {tuple(r) for r in a.unique_value(df, ["k"], "v").collect()} == {("a", "1")}


def fold(rows):
    kept = None
    for r in rows:
        if kept is None or r[2] > kept[2] or (r[3] and not kept[3]):
            kept = r
    return kept


@pytest.mark.parametrize("flag_share", [0.0, 0.15, 0.5, 1.0])
def test_ordered_fold_equals_sequential_fold(spark, flag_share):
    rnd = random.Random(flag_share)
    rows, orders = [], list(range(4000))
    rnd.shuffle(orders)
    for i, o in enumerate(orders):
        # key 0 holds a third of all rows; the others have a handful each
        key = 0 if i % 3 == 0 else rnd.randrange(1, 400)
        rows.append((key, o, rnd.choice([0, 1, 2, 3, 50]) if key else rnd.randrange(5), rnd.random() < flag_share))
    df = spark.createDataFrame(rows, "k int, ord long, size long, flag boolean")
    # fragments of 64 rows, so keys span many of them
    got = a.ordered_fold(df, ["k"], "size", "flag", "ord", F.shiftright("ord", 6))
    actual = {r.k: r.ord for r in got.collect()}
    expected = {}
    for k in {r[0] for r in rows}:
        expected[k] = fold(sorted((r for r in rows if r[0] == k), key=lambda r: r[1]))[1]
    assert actual == expected


def test_exact_percentiles(spark):
    rnd = random.Random(2)
    rows = [("hot", round(rnd.gauss(1, 0.05), rnd.choice([2, 6]))) for _ in range(1500)] + [("few", v) for v in (1.0, 1.0, 3.5)] + [("one", 2.25), ("neg", -1.5), ("neg", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    q = {"p25": 0.25, "p50": 0.5, "p90": 0.9, "top": 1.0}
    for ordered in (200_000, 200, 5):
        got = {r.k: r for r in a.exact_percentiles(df, ["k"], "v", q, ordered).collect()}
        for k in ("hot", "few", "one", "neg"):
            values = [v for key, v in rows if key == k]
            assert got[k].n == len(values)
            for name, share in q.items():
                assert got[k][name] == pytest.approx(np.quantile(values, share)), (k, name, ordered)


def test_exact_percentiles_of_values_that_crowd_in_one_place(spark):
    # all values but two lie within a millionth of the range
    rows = [("k", -1e9), ("k", 1e9)] + [("k", 5 + i * 1e-7) for i in range(3000)] + [(None, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in a.exact_percentiles(df, ["k"], "v", {"m": 0.5, "p": 0.913}, 40).collect()}
    for k in ("k", None):
        values = [v for key, v in rows if key == k]
        assert got[k].n == len(values)
        assert (got[k].m, got[k].p) == (pytest.approx(np.quantile(values, 0.5), rel=1e-12), pytest.approx(np.quantile(values, 0.913), rel=1e-12))


def test_positions(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(4), i) for i in rnd.sample(range(10_000), 3000)]
    df = spark.createDataFrame(rows, "g int, o long").repartition(7)
    got = {r.o: r.position for r in with_position(df, ["o"]).collect()}
    assert got == {o: i + 1 for i, o in enumerate(sorted(r[1] for r in rows))}
    grouped = {(r.g, r.o): r.position for r in with_group_position(df, ["g"], ["o"]).collect()}
    for g in range(4):
        for i, o in enumerate(sorted(r[1] for r in rows if r[0] == g)):
            assert grouped[(g, o)] == i + 1


def test_position_of_nothing(spark):
    assert with_position(spark.createDataFrame([], "o long"), ["o"]).count() == 0


def test_fragment_holds_a_bounded_number_of_values(spark):
    got = spark.range(0, 2**22, 2**18).select(fragment_of("id").alias("f")).distinct().count()
    assert got == 4


def test_group_counts(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), ("a",)], "m string")
    assert {r.m: r.rows for r in a.group_counts(df, "m").collect()} == {"a": 2, "UNKNOWN": 2}


def test_weighted_percentiles_repeat_values(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), rnd.random(), rnd.randrange(4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    for ordered in (200_000, 30):
        for r in a.exact_percentiles(df, ["k"], "v", {"p": 0.3, "q": 0.75}, ordered, weight="w").collect():
            values = [v for k, v, w in rows for _ in range(w) if k == r.k]
            assert (r.n, r.p, r.q) == (len(values), pytest.approx(np.quantile(values, 0.3)), pytest.approx(np.quantile(values, 0.75)))


def test_fold_of_a_hot_key_on_one_day_in_fragments_of_bounded_size(spark):
    rnd = random.Random(11)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice("abcdef"), 1, i, rnd.randrange(50), rnd.random() < 0.1) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, day int, o long, size int, flag boolean").repartition(5)
    cut = with_fragment(df, ["k"], ["day", "o"], rows=100)
    sizes = [r["count"] for r in cut.groupBy("k", "fragment").count().collect()]
    assert max(sizes) <= 100 and len(sizes) >= 30
    got = {r.k: (r.size, r.flag, r.o) for r in a.ordered_fold(cut, ["k"], "size", "flag", "position", "fragment").collect()}
    for k in {r[0] for r in rows}:
        kept = None
        for _, _, o, size, flag in (r for r in rows if r[0] == k):
            if kept is None or size > kept[0] or (flag and not kept[1]):
                kept = (size, flag, o)
        assert got[k] == kept
