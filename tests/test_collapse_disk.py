"""Cut lineage is stored compressed; both ways of collapsing snapshots give the same rows."""

import inspect
import random
import re
import time
from pathlib import Path

from pyspark.sql import functions as F
from test_dedupe_resolve import frame, listing

from deedlink.operators.dedupe import FILLABLE_FIELDS, collapse_snapshots, listing_rank
from deedlink.operators.enrich import OVERLAID_FIELDS, listing_fields, overlay
from deedlink.functions.keys import parcel_number
from deedlink.operators.ordering import with_position
from deedlink.session import cut_lineage, passing_cuts, shared_folder
from deedlink.workloads.jobs import _derived_enrichment


def test_cut_lineage_is_compressed_and_read_by_column(spark):
    df = spark.range(1000).select("id", F.lit("the same text in every row").alias("text"), F.struct(F.col("id"), F.array(F.lit(1))).alias("s"))
    cut = cut_lineage(df)
    assert cut.schema.simpleString() == df.schema.simpleString() and cut.exceptAll(df).isEmpty()
    assert cut.inputFiles() and all(f.endswith(".parquet") for f in cut.inputFiles())
    assert "ReadSchema: struct<id:bigint>" in cut.select("id")._jdf.queryExecution().executedPlan().toString()


def test_few_and_many_rows_of_a_key_collapse_alike(spark):
    rnd = random.Random(5)
    some = lambda *values: rnd.choice([None, *values])
    rows = [
        listing(
            i, uid=f"u{i:03}", listingNumber=some("1", "2", "3", *[f"n{k}" for k in range(40)]) or "", status=rnd.choice(["Sold", "Active", ""]),
            apn=some("1111111111", "1111111111", "2222222222") if i % 9 == 0 else None, zip=some(" ", "98101") or "", beds=some(0, 3), baths=some(float("nan"), 1.5),
            sellingDate=some("2026-01-02"), dom=some(0, 5, 9), view=some("Bay", "") or "",
        )
        for i in range(300)
    ]
    df = frame(spark, rows)

    def run(few):
        r = collapse_snapshots(df, "listingNumber", "ord", listing_rank(df), FILLABLE_FIELDS, parcel_number("apn"), few_rows=few)
        return sorted(map(str, r.rows.collect())), tuple(r.counts.first())

    whole = run(1000)
    assert whole == run(0) == run(6)
    assert whole[1][0] > 0 and whole[1][2] > 0


def test_keys_dealt_to_passes_collapse_alike(spark):
    rnd = random.Random(6)
    rows = [
        listing(i, uid=f"u{i:03}", listingNumber=rnd.choice(["", "hot", *[f"n{k}" for k in range(60)]]), status=rnd.choice(["Sold", "Active"]), apn=rnd.choice([None, None, "1111111111"]), beds=i % 3)
        for i in range(400)
    ]
    df = frame(spark, rows)

    def run(passes, few):
        r = collapse_snapshots(df, "listingNumber", "ord", listing_rank(df), FILLABLE_FIELDS, parcel_number("apn"), few_rows=few, passes=passes)
        return sorted(map(str, r.rows.collect())), tuple(r.counts.first())

    assert run(1, 1000) == run(3, 1000) == run(4, 6)


def cuts(spark):
    return {f.name for f in Path(shared_folder(spark)).glob("cut-*")}


def test_passing_cuts_leave_only_what_is_kept(spark):
    before = cuts(spark)
    with passing_cuts(spark):
        with passing_cuts(spark) as kept:
            first = cut_lineage(spark.range(10))
            second = kept(first.where("id > 4"))
            with_position(first, ["id"]).collect()
        assert len(cuts(spark) - before) == 1 and second.count() == 5
    assert cuts(spark) == before
    cut_lineage(spark.range(3))
    assert len(cuts(spark) - before) == 1


def test_enrichment_leaves_only_frames_that_its_table_reads(spark):
    before = cuts(spark)
    table = _derived_enrichment(spark, "/root/testdata/sf0.001").table
    assert cuts(spark) - before <= {Path(f.removeprefix("file:")).parent.name for f in table.inputFiles()}


def test_shuffles_of_a_cut_frame_are_removed(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    tables = [cut_lineage(spark.range(1000).repartition(3, "id")) for _ in range(3)]
    known = tracker.shuffleStatuses().size()
    tables += [cut_lineage(spark.range(1000).repartition(3, "id")) for _ in range(3)]
    for _ in range(50):
        if tracker.shuffleStatuses().size() <= known:
            break
        time.sleep(0.1)
    assert tracker.shuffleStatuses().size() <= known and all(t.count() == 1000 for t in tables)


def test_overlay_reads_only_the_fields_that_travel():
    used = set(re.findall(r'c\["(\w+)"\]', inspect.getsource(overlay) + inspect.getsource(listing_fields)))
    assert used == set(OVERLAID_FIELDS)
