"""Cross-filters, map places and heat tiles on small tables."""

import random
from collections import Counter
from statistics import median_low

import pytest
from pyspark.sql import functions as F

from deedlink.operators import filters as f, maps


def test_cross_filter_equals_a_filter_per_facet(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc") if rnd.random() < 0.9 else None, rnd.randrange(4), rnd.choice([1.5, 2.5, None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "x string, y int, z double, cents long")
    tests = {"x": lambda r: r[0] == "a", "y": lambda r: r[1] >= 2, "z": lambda r: r[2] is not None and r[2] < 2}
    facets = {"x": (F.col("x"), F.col("x") == "a"), "y": (F.col("y"), F.col("y") >= 2), "z": (F.col("z"), F.col("z") < 2)}
    rows_of, cents_of = Counter(), Counter()
    for r in rows:
        for i, name in enumerate(tests):
            if all(t(r) for n, t in tests.items() if n != name):
                key = (name, None if r[i] is None else str(r[i]))
                rows_of[key] += 1
                cents_of[key] += r[3]
        if all(t(r) for t in tests.values()):
            rows_of[f.ALL_FACETS, None] += 1
            cents_of[f.ALL_FACETS, None] += r[3]
    got = f.cross_filter(df, facets, {"cents": F.col("cents")}).collect()
    assert {(r.facet, r.value): (r.rows, r.cents) for r in got} == {k: (n, cents_of[k]) for k, n in rows_of.items()}
    assert f.cross_filtered_rows(df, facets).count() == rows_of[f.ALL_FACETS, None]


def test_cross_filter_scans_once_and_shuffles_once(spark, tmp_path):
    spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("k")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    result = f.cross_filter(df, {"a": (F.col("k"), F.col("k") > 0), "b": (F.col("id"), F.col("id") < 50)})
    plan = result._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1
    assert result._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_rows_without_place_go_to_the_first_area_with_a_centre(spark):
    rnd = random.Random(9)
    rows = [(i, f"z{i % 3}", f"n{i % 2}", 47 + rnd.random() / 10, -122 - rnd.random() / 10) for i in range(101)]
    rows += [(200, "z0", "n0", None, -122.0), (201, "z9", "n1", 47.0, None), (202, None, " ", None, None), (203, "", "n0", None, None), (204, "z9", "n9", None, None)]
    df = spark.createDataFrame(rows, "id long, zip string, hood string, lat double, lon double")
    got = {r.id: (r.mapSource, r.mapLat, r.mapLon) for r in maps.with_map_place(df, ["zip", "hood"]).collect()}

    def centre(place, name):
        own = [r for r in rows if r[place] == name and r[3] is not None and r[4] is not None]
        return tuple((median_low([int(r[c] * 10_000 // 1) for r in own]) + 0.5) / 10_000 for c in (3, 4))

    assert len(got) == len(rows) and got[7] == ("exact", rows[7][3], rows[7][4])
    assert got[200] == ("zip", *centre(1, "z0"))
    assert got[201] == ("hood", *centre(2, "n1")) and got[203] == ("hood", *centre(2, "n0"))
    assert got[202] == got[204] == ("none", None, None)


def test_tiles_of_a_level_add_up_the_next_deeper_ones(spark):
    rnd = random.Random(1)
    rows = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180), i) for i in range(400)] + [(90.0, -180.0, 1), (-90.0, 180.0, 2), (None, 3.0, 5), (95.0, -200.0, 7)]
    df = spark.createDataFrame(rows, "lat double, lon double, v long")
    got = maps.heat_tiles(df, F.col("lat"), F.col("lon"), [2, 5, 30, 5], {"v": F.col("v")}).collect()
    for level in (2, 5, 30):
        side, expected = 1 << level, Counter()
        for lat, lon, _ in rows:
            clip = lambda share: max(0, min(side - 1, int(share * side // 1)))
            expected[(clip((lon + 180) / 360), clip((90 - lat) / 180)) if lat is not None else (None, None)] += 1
        mine = [r for r in got if r.level == level]
        assert {(r.column, r.line): r.rows for r in mine} == expected
        assert sum(r.v for r in mine) == sum(r[2] for r in rows)
        bits = lambda n: sum(((n >> i) & 1) << (2 * i) for i in range(31))
        assert all(r.tile == bits(r.column) + 2 * bits(r.line) for r in mine if r.tile is not None)
    with pytest.raises(ValueError):
        maps.tile(F.col("lat"), F.col("lon"), 31)
