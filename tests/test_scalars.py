"""Scalar functions against literal inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from deedlink.functions import address as a
from deedlink.functions import dates as d
from deedlink.functions import keys as k
from deedlink.functions import numbers as n
from deedlink.functions import places as p
from deedlink.functions import presence as pr
from deedlink.functions import text as t
from deedlink.sources.files import canonical_name, numbered_names, pick_column


def check(spark, function, cases, kind="string"):
    """All cases in one job."""
    rows = [(i, value) for i, (value, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, f"i int, v {kind}").select("i", function(F.col("v")).alias("r")).orderBy("i")
    actual = [r.r for r in got.collect()]
    assert actual == [e for _, e in cases], list(zip(cases, actual))


def test_numbers(spark):
    check(spark, n.parse_number, [
        ("$1,250,000", 1250000.0), ("", 0.0), (None, 0.0), ("bad", 0.0), ("1e5", 15.0), ("1-2", 0.0), ("-5.5", -5.5),
        (".5", 0.5), ("5.", 5.0), ("-", 0.0), (" ", 0.0), ("1.2.3", 0.0), ("(3)", 3.0),
    ])
    strict = lambda c: F.isnan(n.parse_number_strict(c))
    check(spark, strict, [("1-2", True), ("47.5", False), ("", False), (None, False)])
    check(spark, n.round_half_up, [(2.5, 3), (-2.5, -2), (2.4, 2), (-2.6, -3)], "double")
    check(spark, t.integer_text, [("1,234.5", "1235"), ("", ""), (None, ""), ("0", "0"), ("n/a", "0")])


@pytest.mark.parametrize("digits,cases", [
    (2, [(1.005, "1.00"), (1.015, "1.01"), (2.5, "2.50"), (0.0, "0.00"), (8.345, "8.35"), (-1.255, "-1.25"), (0.125, "0.13"), (3.999, "4.00")]),
    (4, [(1.03125, "1.0313"), (0.99995, "1.0000"), (0.00005, "0.0001"), (1.00005, "1.0001"), (1.23456789, "1.2346"), (-0.5, "-0.5000")]),
])
def test_fixed_text_follows_the_binary_value(spark, digits, cases):
    check(spark, lambda c: n.fixed_text(c, digits), cases, "double")


def test_fixed_text_against_decimal_arithmetic(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    rnd = random.Random(3)
    values = [rnd.randrange(1, 10**7) / 10**rnd.randrange(2, 7) for _ in range(3000)] + [rnd.random() * 3 for _ in range(1000)] + [rnd.random() / 2000 for _ in range(500)] + [k / 32 for k in range(200)]
    cases = [(v, str(Decimal(v).quantize(Decimal("0.0001"), ROUND_HALF_UP))) for v in values]
    check(spark, lambda c: n.fixed_text(c, 4), cases, "double")


def test_number_text(spark):
    check(spark, n.number_text, [(2.0, "2"), (2.5, "2.5"), (47.123456, "47.123456"), (-122.0, "-122"), (0.0, "0")], "double")


def test_dates(spark):
    day = dt.date
    check(spark, d.us_date, [
        ("1/5/2025", day(2025, 1, 5)), ("01/05/2025", day(2025, 1, 5)), ("2025-01-05", None), ("2/30/2025", None),
        ("", None), (None, None), ("1/5/25", None),
    ])
    check(spark, d.lenient_date, [
        ("2025-01-05", day(2025, 1, 5)), ("3/19/2026 12:00:00 AM", day(2026, 3, 19)), (" 3/9/2026 ", day(2026, 3, 9)),
        ("Mar 3, 2025", day(2025, 3, 3)), ("March 3, 2025", day(2025, 3, 3)), ("2025/3/5", day(2025, 3, 5)),
        ("2025-03-05T10:11:12", day(2025, 3, 5)), ("soon", None), ("", None), (None, None), ("2025-02-30", None),
    ])
    check(spark, d.sortable_date, [(day(2025, 1, 5), 20250105), (None, 0)], "date")
    check(spark, d.year_before, [(day(2025, 6, 1), day(2024, 6, 1)), (day(2024, 2, 29), day(2023, 3, 1)), (day(2025, 2, 28), day(2024, 2, 28))], "date")


def test_day_diff(spark):
    row = spark.sql("select date'2025-01-05' a, date'2025-02-01' b, cast(null as date) c")
    assert row.select(d.day_diff("a", "b"), d.day_diff("b", "a"), d.day_diff("a", "c")).first() == (27, -27, None)


def test_text(spark):
    check(spark, t.unquoted, [('"a b"', "a b"), (' "x', '"x'), (None, ""), ('"', "")])
    check(spark, t.squeezed, [("  a \t b c ", "a b c"), (None, ""), ("", "")])
    check(spark, t.zip5, [("98101-1234", "98101"), ("WA 98103", "98103"), ("9810", ""), (None, "")])
    check(spark, t.is_po_box, [("P.O. Box 7", True), ("PO BOX 12", True), ("p o box", True), ("Poboxer 3", False), ("12 PO BOX LN", False)])
    check(spark, t.looks_street_like, [("12 Main St", True), ("Main St", False), ("123", False), (" 9 A", True)])
    check(spark, t.looks_numeric, [("12", True), (" 12 ", True), ("12a", False), ("", False), (None, False)])
    check(spark, t.boolean_text, [("TRUE", "true"), ("False", "false"), ("", ""), (None, ""), ("Y", "true"), ("0", "false"), ("Maybe so", "Maybe so")])
    check(spark, t.boolean_value, [("yes", True), ("no", False), ("", None), ("maybe", None)])
    check(spark, t.approval_text, [("None", "None"), ("NONE", "None"), ("Short Sale", "Short Sale"), ("short sale", "Short Sale"), ("Other - x", "Other - See Remarks"), ("Otherwise", "Otherwise"), ("", "")])
    check(spark, t.status_text, [
        ("SOLD", "Sold"), (" active ", "Active"), ("pending bu requested", "Pending BU Requested"), ("", ""), (None, ""),
        ("short-sale now", "Short-Sale Now"), ("PENDING FEASIBILITY", "Pending Feasibility"), ("cancelled", "Cancelled"),
    ])
    check(spark, t.status_rank, [("Sold", 700), ("pending inspection", 630), ("Contingent", 500), ("Active", 100), ("Other", 0), (None, 0)])
    check(spark, t.status_penalty, [("Pending", 0), ("Active", 4), ("Sold", 5), (None, 5)])
    check(spark, t.type_from_style, [("32 - Townhouse", "Townhouse"), ("CONDO", "Condo"), ("Multi Unit", "Multi-Family"), ("Floating", "Floating Home"), ("", "Single Family"), ("11", "Single Family")])
    check(spark, t.region_from_name, [
        ("Cental Seattle Stats 2_9 to 3_20.csv", "Central Seattle"), ("QA_Magnolia Sale Stats.csv", "QA Magnolia"),
        ("Sold And Stats - QA.csv", "QA Magnolia"), ("Sold And Stats - NW.csv", "NW Seattle"), ("Stats.csv", "Seattle"),
        ("NE Seattle Rich Snapshot.csv", "NE Seattle"), ("Central.CSV", "Central Seattle"), ("ne full.csv", "NE Seattle"),
    ])


def test_speed_tag(spark):
    rows = spark.createDataFrame([(0, None), (1, None), (5, None), (6, None), (10, None), (11, None), (0, -3), (30, 5), (30, 6), (30, 10), (30, 11)], "dom int, wait int")
    got = [r[0] for r in rows.select(t.speed_tag("dom", "wait")).collect()]
    u, h = "ULTRA_HOT_<=5D", "HOT_MARKET_<=10D"
    assert got == ["", u, u, h, h, "", u, u, h, h, ""]


def test_keys(spark):
    check(spark, k.parcel_number, [("1234567890", "1234567890"), ("123-456-7890", "1234567890"), ("123", None), ("12345678901", None), (None, None)])
    check(spark, k.last_parcel_digits, [("991234567890", "1234567890"), ("123", None), (None, None)])
    pair = spark.createDataFrame([("12", "3"), ("1234567", "12345"), ("", "1"), ("a", "b"), (None, "7")], "a string, b string")
    got = pair.select(k.parcel_from_parts("a", "b"), k.parcel_padding_blanks("a", "b")).collect()
    assert [tuple(r) for r in got] == [("0000120003", "0000120003"), ("2345672345", "2345672345"), (None, "0000000001"), (None, "0000000000"), (None, "0000000007")]
    base = spark.createDataFrame([("1234567890", "x", "y"), ("", "123456", "7890"), (None, "123", "4")], "p string, a string, b string")
    assert [r[0] for r in base.select(k.base_parcel("p", "a", "b")).collect()] == ["1234567890", "1234567890", None]


def test_addresses(spark):
    row = spark.createDataFrame([("717", "B", "", "Martin Luther King Jr.", "Wy", "S", "98144", "Seattle", "WA")], "num string, unit string, dir string, name string, suffix string, post string, zip string, city string, state string")
    got = row.select(
        a.listing_street("num", "dir", "name", "suffix", "post", "unit"),
        a.listing_street("num", "dir", "name", "suffix", "post"),
        a.listing_display_address("num", "dir", "name", "suffix", "post", "unit", "city", "state", "zip"),
    ).first()
    assert tuple(got) == ("717 B MARTIN LUTHER KING JR WAY S", "717 MARTIN LUTHER KING JR WAY S", "717 Martin Luther King Jr. Wy S B, Seattle WA 98144")
    check(spark, a.without_trailing_unit, [("1220 E Columbia St #105", "1220 E COLUMBIA ST"), ("5 Unit Way", "5"), ("", "")])
    check(spark, lambda c: a.address_key(c, F.lit("98144")), [("717 B Martin Luther King Jr Way S", "717 B MARTIN LUTHER KING JR WAY S|98144"), ("", None), (None, None), (" .", None)])
    check(spark, a.canonical_address, [
        ("12 North-East Avenue, Apt. 3", "12 N-E AVE UNIT 3"), ("9 Southwest Boulevard Suite 4", "9 SW BLVD UNIT 4"),
        ("1 Norths Street Court Drive Road Lane Terrace Parkway Highway Circle Junior Place", "1 NORTHS ST CT DR RD LN TER PKWY HWY CIR JR PL"),
        ("8 ste 9", "8 UNIT 9"),
    ])
    check(spark, a.situs_address, [("12 Main St, 98101", "12 Main St,"), ("12 Main St 98101-1234 ", "12 Main St"), ("12 Main St ,", "12 Main St"), (None, "")])
    check(spark, lambda c: a.street_in_city(c, F.lit("98101")), [("12 Main St", "12 Main St, Seattle 98101"), ("1 Seattle Ave", "1 Seattle Ave"), ("", "")])
    check(spark, lambda c: a.mailing_address(c, F.lit("Kent WA"), F.lit("98030")), [("1 A St", "1 A St, Kent WA, 98030"), ("1 A St 98030", "1 A St 98030, Kent WA"), ("", "Kent WA, 98030")])


def test_address_choice(spark):
    schema = "line string, city string, zip string, text string, site string, siteZip string"
    rows = [
        ("9 Mail St", "KENT WA", "98030", "9 Mail St, KENT WA, 98030", "12 Site St", "98101"),
        ("9 Mail St", "KENT WA", "98030", "m", "12 Site St", "98030"),
        ("PO BOX 9", "KENT WA", "98030", "m", "12 Site St", "98030"),
        ("PO BOX 9", "KENT WA", "98030", "PO BOX 9, KENT WA, 98030", "", ""),
        ("", "", "", "", "", ""),
        ("9 Mail St", "", "", "m", "", "98102"),
        ("9 Mail St", "SEATTLE WA", "98103", "m", "no number", ""),
    ]
    df = spark.createDataFrame(rows, schema)
    df = a.with_chosen_address(df, "line", "city", "zip", "text", "site", "siteZip", "c")
    got = [tuple(r.c) + (r.ok,) for r in df.select("c", a.trusted_address(F.col("c.address"), F.col("c.source"), F.col("c.zip")).alias("ok")).collect()]
    assert got == [
        ("12 Site St, Seattle 98101", "SITUS_PROXY", "98101", True),
        ("9 Mail St, KENT WA 98030", "MAILING_STREET", "98030", False),
        ("12 Site St, Seattle 98030", "SITUS_PROXY", "98030", True),
        ("PO BOX 9, KENT WA, 98030", "MAILING_FALLBACK", "98030", False),
        ("Seattle", "MAILING_FALLBACK", "", False),
        ("9 Mail St, SEATTLE WA 98102", "MAILING_STREET", "98102", True),
        ("9 Mail St, SEATTLE WA 98103", "MAILING_STREET", "98103", True),
    ]


def test_places(spark):
    check(spark, p.county_neighborhood, [("98107", "Ballard"), ("98111-0001", "Downtown"), ("98199", "Magnolia"), ("99999", None), ("", None)])
    check(spark, p.enrichment_neighborhood, [("98107", "Ballard / Crown Hill"), ("98111", None), ("98199", "Magnolia")])
    assert (len(p.COUNTY_NEIGHBORHOODS), len(p.ENRICHMENT_NEIGHBORHOODS)) == (31, 25)


def test_presence(spark):
    df = spark.createDataFrame([("x", 1, 2.0), ("", 0, 0.0), (" ", None, float("nan")), (None, -1, float("inf"))], "s string, i int, d double")
    got = [tuple(r) for r in df.select(*[pr.present(df, c).alias(c) for c in df.columns]).collect()]
    assert got == [(True, True, True), (False, False, False), (False, False, False), (False, True, False)]


def test_header_names():
    assert numbered_names([" A", "B", "A", "A"]) == ["A", "B", "A (2)", "A (3)"]
    assert canonical_name(' "Centroid_Lat" ') == "centroidlat"
    assert pick_column(["PIN", "Lat Itude"], ["latitude"]) == "Lat Itude"
    assert pick_column(["PIN"], ["lon"]) is None
