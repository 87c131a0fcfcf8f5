"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from deedlink.session import local_session  # noqa: E402
from deedlink.workloads import load_all  # noqa: E402

HEADLINE = [
    "tolerance_match",
    "asof_stub",
    "greedy_assign",
    "greedy_orders",
    "ranked_fill_dedupe",
    "conflict_guard",
    "resolution_cascade",
    "unique_lookup",
    "first_present_snapshot",
    "argmax_record",
    "learned_label",
    "ordered_fold",
    "lookup_chain",
    "enriched_union",
    "outcome_metrics",
    "overlay_and_fill",
    "address_canonical",
    "canonical_presold",
    "validation_report",
    "geo_ratio_buckets",
    "kpi_summary",
    "cross_filter_facets",
    "located_rows",
    "heat_tiles",
    "scenario_bids",
    "bid_recommend",
    "comp_rows",
    "top_bids",
    "row_positions",
    "county_build",
    "enrichment",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="deedlink-bench", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="deedlink-bench-")})
    known = load_all()
    # start the executors' code paths before anything is timed
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_custkey").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
