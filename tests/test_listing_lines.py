"""Lines of exports cut into cells: once a line, under the names of the first header."""

from pyspark.sql import functions as F

from deedlink.sources.listings import REQUIRED_LISTING_COLUMNS, cells_of_lines, find_headers, read_lines, typed_listings

HEADER = ",".join([*REQUIRED_LISTING_COLUMNS, "Listing Number", "View", "Listing Number"])


def _line(number, view, second=""):
    return ",".join(["Active", *[""] * (len(REQUIRED_LISTING_COLUMNS) - 1), number, view, second])


def _lines(spark):
    talk = 'all about "Listing Number, Status"'
    rows = [("b.csv", 0, talk), ("b.csv", 1, HEADER), ("b.csv", 2, _line("B1", '"Bay,  ""Park"""')), ("b.csv", 3, _line("", "", "B2")), ("b.csv", 4, HEADER)]
    rows += [("a.csv", 0, HEADER), ("a.csv", 1, _line("A1", talk.replace('"', ""))), ("a.csv", 2, "Sold")]
    return spark.createDataFrame(rows, "file string, row long, value string")


def test_a_line_is_parsed_once(spark):
    rows = spark.range(9).select(F.lit("a.csv").alias("file"), F.col("id").alias("row"), F.when(F.col("id") == 0, HEADER).otherwise(_line("A1", "")).alias("value"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(typed_listings(cells_of_lines(rows))).count("from_csv(") == 1
    # nor does the search for headers parse lines to see whether they are missing
    assert all("from_csv(" not in line for line in plan(find_headers(rows, 15)).splitlines() if "Filter" in line)
    assert plan(find_headers(rows, 15)).count("from_csv(") == 1


def test_cells_of_two_headers(spark):
    got = {(r.file, r.rowIndex): r for r in cells_of_lines(_lines(spark)).collect()}
    assert sorted(got) == [("a.csv", 0), ("a.csv", 1), ("b.csv", 0), ("b.csv", 1), ("b.csv", 2)]
    assert got["b.csv", 0]["View"] == 'Bay,  "Park"' and got["b.csv", 1]["Listing Number (2)"] == "B2"
    assert got["b.csv", 2]["Status"] == "Status" and got["b.csv", 0]["APN"] is None
    assert got["a.csv", 1]["Status"] == "Sold" and got["a.csv", 1]["View"] == ""
    assert got["a.csv", 1].ord < got["b.csv", 0].ord < got["b.csv", 1].ord


def test_lines_are_numbered_without_a_shuffle_of_the_lines(spark, tmp_path):
    for name in ("_a.csv", "b.csv"):
        (tmp_path / name).write_text("one\n\ntwo\nthree\n")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the lines are many
    try:
        lines = read_lines(spark, str(tmp_path))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert got == [(name, i, value) for name in ("_a.csv", "b.csv") for i, value in enumerate(("one", "two", "three"))]


def test_cutting_is_compiled_and_spread(spark):
    lines = _lines(spark).coalesce(1)
    cells = cells_of_lines(lines)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    # Spark interprets what stands in a generator, so nothing but the parser stands there
    made = [line for line in plan.splitlines() if "Generate" in line]
    assert len(made) == 1 and "from_csv(" in made[0] and "transform(" not in made[0] and "trim(" not in made[0]
    assert cells.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.ord for r in cells.collect()) == sorted(r.ord for r in cells_of_lines(_lines(spark)).collect())


def test_listing_cells_cuts_lines_once(spark):
    from deedlink.workloads import load_all

    got = load_all()["listing_cells"].run(spark, "/root/testdata/sf0.001")
    assert "from_csv(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.file for r in got.collect()) == ["QA_Magnolia Sale Stats.csv", "Sold And Stats - NW.csv"]
