"""Sharding and archives."""

import hashlib
import zlib

import duckdb
from oracle import compare, connect
from pyspark.sql import functions as F

from deedlink.llm import capture_index as ci, shards

DIMS = ["n_chars", "source", "lang", "doc_id"]


def check_shards(rows, n, most):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        assert 0 <= r.shard < n
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    sizes = [sum(r["size"] for r in by.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= most
    return sizes


def test_op1_is_whole_and_even(spark, small, texts, queries):
    rows = queries["op1_kd_shards"](spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    largest = max(len(t.encode()) for t in texts.values()) + 16
    check_shards(rows, 40, 3 * largest)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)


def test_shards_cut_where_a_sequential_tree_cuts(spark):
    rows = [(i, "x" * (50 + i % 7), f"s{i % 5}", "en", 50 + i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = shards.kd_shards(df, ["doc_id"], shards=8).collect()
    check_shards(got, 8, 3 * 73)
    # one dimension: shards are runs of the ids
    order = [r.shard for r in sorted(got, key=lambda r: r.doc_id)]
    assert order == sorted(order)


def test_equal_rows_are_parted_too(spark):
    df = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"), F.lit("l").alias("lang"), F.lit(4).alias("n_chars"))
    check_shards(shards.kd_shards(df, DIMS, shards=7).collect(), 7, 4 * 20)


def test_shards_by_target_bytes_and_odd_rows(odd, empty):
    rows = shards.kd_shards(odd, DIMS, target_bytes=40_000).collect()
    assert len(rows) == odd.count()
    assert len({r.shard for r in rows}) == max(r.shard for r in rows) + 1
    assert shards.kd_shards(empty, DIMS, shards=4).collect() == []
    assert len(shards.kd_shards(odd, DIMS, shards=40).collect()) == odd.count()


def test_op2_equals_sql(spark, small, queries):
    assert compare(spark, connect(small), small, queries["op2_capture_index"], ci.CAPTURES_SQL) is None


PAGES = [
    (5, "http://a.b/x", "<p>" + "z" * 200), (5, "http://a.b/y", "<p>" + "z" * 200), (2, None, "<p>" + "z" * 200),
    (None, "HTTP://U@A.b:80?q#f", None), (7, "", ""), (8, "x", "short"), (9, "x", "short"), (2, "q", "<p>" + "z" * 200),
    (None, "w", "<p>" + "z" * 200), (11, "http://a.b/long", "é🙂" * 100_000),
]


def test_captures_of_odd_pages(spark):
    df = spark.createDataFrame([(*p, "c") for p in PAGES], "page_id long, url string, html string, file string").repartition(3)
    rows = ci.captures(df).collect()
    assert len(rows) == len(PAGES)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in rows)
    want, seen = [], False
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        kind, refers = "response", 0
        if html and html.startswith("<p>"):
            kind, refers = ("revisit", 2) if page_id != 2 or seen else ("response", 0)
            seen = seen or page_id == 2
        want.append((page_id is None, page_id or 0, len(data), hashlib.sha256(data).hexdigest(), kind, refers))
    assert got == sorted(want)
    assert ci.captures(df.where("false")).collect() == []


def test_index_is_searched_in_two_levels(spark, tmp_path):
    n = 3000
    entries = spark.range(n).select(
        F.col("id").alias("page_id"), F.format_string("com,h%03d)/%d", F.col("id") % 40, F.col("id") % 100).alias("url_key"),
        F.lit("f").alias("file"), F.col("id").alias("offset"), F.lit(1).cast("long").alias("length"),
    )
    upper = ci.write_index(entries, str(tmp_path / "index"), block_entries=16)
    assert upper.agg(F.sum("entries")).first()[0] == n
    reader = ci.IndexReader([(r.first_key, r.file) for r in upper.collect()])
    want = {}
    for i in range(n):
        want.setdefault(f"com,h{i % 40:03d})/{i % 100}", []).append(i)
    for key, ids in want.items():
        assert sorted(e[1] for e in reader.find(key)) == ids
    assert list(reader.find("com,zzz)/")) == list(reader.find("")) == []
    keys = spark.createDataFrame([(k,) for k in list(want)[:50]] + [("nowhere)/",), (None,), (list(want)[0],)], "url_key string")
    assert ci.look_up(keys, upper).count() == sum(len(want[k]) for k in list(want)[:50])


def test_url_keys(spark):
    cases = {"http://www.Ex.com/A?b=1#c": "com,ex,www)/A?b=1", "https://ex.com": "com,ex)/", "http://u:p@ex.com:8080?x": "com,ex:8080)?x", "": ")/"}
    df = spark.createDataFrame(list(cases.items()), "url string, want string")
    assert df.where(ci.url_key(F.col("url")) != F.col("want")).collect() == []


def test_duckdb_has_the_digest():
    assert duckdb.sql("SELECT sha256('a')").fetchall()[0][0] == hashlib.sha256(b"a").hexdigest()
