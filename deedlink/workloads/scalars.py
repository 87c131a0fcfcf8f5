"""Row-wise functions on columns of the given tables, and texts built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from deedlink.functions import address as a
from deedlink.functions import dates as d
from deedlink.functions import keys as k
from deedlink.functions import numbers as n
from deedlink.functions import places as p
from deedlink.functions import text as t
from deedlink.functions.presence import count_present
from deedlink.workloads.registry import (
    cents,
    day,
    day_text,
    sql_case,
    sql_cents,
    sql_day_text,
    table,
    workload,
)

NUMBER_SQL = "coalesce(CASE WHEN {k} = '' THEN 0.0 ELSE try_cast({k} AS DOUBLE) END, 0.0)"


def sql_number(expression: str) -> str:
    """Text to number as the engine does it."""
    return NUMBER_SQL.format(k=f"regexp_replace(coalesce({expression}, ''), '[^0-9.-]', '', 'g')")


@workload(f"""
    SELECT c_custkey,
           {sql_number("'$' || CAST(c_acctbal AS VARCHAR) || ' USD'")} AS money,
           {sql_number("c_name")} AS from_name,
           {sql_number("CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END")} AS none,
           {sql_number("CAST(c_custkey AS VARCHAR) || '-' || CAST(c_nationkey AS VARCHAR)")} AS broken,
           CAST(floor({sql_number("CAST(c_acctbal AS VARCHAR)")} + 0.5) AS BIGINT) AS rounded,
           CAST(floor(-c_acctbal + 0.5) AS BIGINT) AS rounded_down_side
    FROM customer""")
def parse_numbers(spark, sf):
    c = table(spark, sf, "customer")
    text = F.col("c_acctbal").cast("string")
    return c.select(
        "c_custkey",
        n.parse_number(F.concat(F.lit("$"), text, F.lit(" USD"))).alias("money"),
        n.parse_number("c_name").alias("from_name"),
        n.parse_number(F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))).alias("none"),
        n.parse_number(F.concat_ws("-", "c_custkey", "c_nationkey")).alias("broken"),
        n.parse_integer(text).alias("rounded"),
        n.round_half_up(-F.col("c_acctbal")).alias("rounded_down_side"),
    )


# one of five spellings per row, the last one is no date
SPELLED_SQL = """CASE o_orderkey % 5
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 1 THEN CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(day(o_orderdate) AS VARCHAR) || '/' || CAST(year(o_orderdate) AS VARCHAR)
    WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y') || ' 12:00:00 AM'
    WHEN 3 THEN strftime(o_orderdate, '%b %d, %Y')
    ELSE 'after ' || o_orderpriority END"""


@workload(f"""
    WITH spelled AS (SELECT o_orderkey, {SPELLED_SQL} AS v FROM orders),
    parsed AS (
        SELECT o_orderkey, v,
               coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%m/%d/%Y'), try_strptime(v, '%m/%d/%Y %I:%M:%S %p'),
                        try_strptime(v, '%b %d, %Y')) AS lenient,
               try_strptime(v, '%m/%d/%Y') AS strict
        FROM spelled)
    SELECT o_orderkey, v AS spelled, coalesce({sql_day_text("lenient")}, '') AS lenient,
           coalesce({sql_day_text("strict")}, '') AS strict,
           CAST(coalesce(CAST(strftime(lenient, '%Y%m%d') AS BIGINT), 0) AS BIGINT) AS sortable,
           CAST(coalesce(date_diff('day', CAST(lenient AS DATE), DATE '2001-08-01'), -1) AS BIGINT) AS age
    FROM parsed""")
def parse_dates(spark, sf):
    o = table(spark, sf, "orders")
    date = day("o_orderdate")
    spelled = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(date, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 5 == 1, F.date_format(date, "M/d/yyyy"))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.date_format(date, "MM/dd/yyyy"), F.lit(" 12:00:00 AM")))
        .when(F.col("o_orderkey") % 5 == 3, F.date_format(date, "MMM dd, yyyy"))
        .otherwise(F.concat(F.lit("after "), "o_orderpriority"))
    )
    texts = o.select("o_orderkey", spelled.alias("spelled"))
    lenient = d.lenient_date("spelled")
    return texts.select(
        "o_orderkey",
        "spelled",
        F.coalesce(day_text(lenient), F.lit("")).alias("lenient"),
        F.coalesce(day_text(d.us_date("spelled")), F.lit("")).alias("strict"),
        d.sortable_date(lenient).cast("long").alias("sortable"),
        F.coalesce(d.day_diff(lenient, F.lit("2001-08-01").cast("date")), F.lit(-1)).cast("long").alias("age"),
    )


@workload("""
    WITH k AS (SELECT o_orderkey, 'ORD-' || CAST(o_custkey AS VARCHAR) AS a, CAST(o_orderkey * 7 AS VARCHAR) || 'x' AS b,
                      CAST(o_custkey * 1000003 + 1000000000 AS VARCHAR) AS long_number FROM orders),
    digits AS (SELECT o_orderkey, regexp_replace(a, '[^0-9]', '', 'g') AS a, regexp_replace(b, '[^0-9]', '', 'g') AS b, long_number FROM k)
    SELECT o_orderkey,
           right(CASE WHEN length(a) < 6 THEN lpad(a, 6, '0') ELSE a END, 6)
             || right(CASE WHEN length(b) < 4 THEN lpad(b, 4, '0') ELSE b END, 4) AS parcel,
           CASE WHEN length(long_number) = 10 THEN long_number ELSE '' END AS exact_ten,
           CASE WHEN length(long_number) >= 10 THEN right(long_number, 10) ELSE '' END AS last_ten,
           left(right(long_number, 10), 6) AS major, right(long_number, 4) AS minor
    FROM digits""")
def parcel_key(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("ORD-"), F.col("o_custkey").cast("string")).alias("a"),
        F.concat((F.col("o_orderkey") * 7).cast("string"), F.lit("x")).alias("b"),
        (F.col("o_custkey") * 1000003 + 1000000000).cast("string").alias("number"),
    )
    last = k.last_parcel_digits("number")
    return o.select(
        "o_orderkey",
        k.parcel_from_parts("a", "b").alias("parcel"),
        F.coalesce(k.parcel_number("number"), F.lit("")).alias("exact_ten"),
        F.coalesce(last, F.lit("")).alias("last_ten"),
        k.major_of(last).alias("major"),
        k.minor_of(last).alias("minor"),
    )


# what the rules must give, written out case by case and not taken from the package's tables
@workload("""
    SELECT event_id,
           CASE event_type WHEN 'click' THEN 'Active' WHEN 'view' THEN 'Pending BU Requested' WHEN 'error' THEN 'Sold'
                WHEN 'signup' THEN 'Signup-Like Thing' WHEN 'purchase' THEN 'Purchase-Like Thing' END AS status,
           CAST(CASE event_type WHEN 'click' THEN 100 WHEN 'view' THEN 620 WHEN 'error' THEN 700 ELSE 0 END AS INTEGER) AS rank,
           CAST(CASE event_type WHEN 'view' THEN 2 ELSE 5 END AS INTEGER) AS penalty
    FROM events""")
def status_enum(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    spelled = (
        F.when(kind == "click", " active ")
        .when(kind == "view", "PENDING bu Requested")
        .when(kind == "error", "sold")
        .otherwise(F.concat(kind, F.lit("-like thing")))
    )
    s = e.select("event_id", spelled.alias("v"))
    return s.select(
        "event_id",
        t.status_text("v").alias("status"),
        t.status_rank("v").alias("rank"),
        t.status_penalty("v").alias("penalty"),
    )


# an address out of the words of a part: number, name, one of the street words, type, sometimes a unit
def address_text():
    part, size = F.col("p_partkey"), F.col("p_size").cast("string")
    street = F.when(part % 6 == 0, "North Street").when(part % 6 == 1, "avenue Southwest").when(part % 6 == 2, "East Boulevard,").when(part % 6 == 3, "Wy N.").when(part % 6 == 4, "Place  Northeast").otherwise("Junior Highway")
    unit = F.when(part % 4 == 0, F.concat(F.lit(" #"), size)).when(part % 4 == 1, " apt. B-2").when(part % 4 == 2, ", Suite 7").otherwise("")
    return F.concat(size, F.lit(" "), "p_name", F.lit(" "), street, F.lit(" "), "p_type", unit)


@workload("""
    WITH c AS (
        SELECT p_partkey, '98' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS zip,
               p_size || ' ' || upper(p_name) || ' '
               || CASE p_partkey % 6 WHEN 0 THEN 'N ST' WHEN 1 THEN 'AVE SW' WHEN 2 THEN 'E BLVD' WHEN 3 THEN 'WAY N' WHEN 4 THEN 'PL NE' ELSE 'JR HWY' END
               || ' ' || upper(p_type) AS no_unit,
               CASE p_partkey % 4 WHEN 0 THEN ' UNIT ' || p_size WHEN 1 THEN ' UNIT B-2' WHEN 2 THEN ' UNIT 7' ELSE '' END AS unit
        FROM part)
    SELECT p_partkey, no_unit || unit AS canonical, no_unit || unit || '|' || zip AS address_key, no_unit FROM c""")
def address_canonical(spark, sf):
    raw = table(spark, sf, "part").select(
        "p_partkey",
        address_text().alias("v"),
        F.concat(F.lit("98"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")).alias("zip"),
    )
    return raw.select(
        "p_partkey",
        a.canonical_address("v").alias("canonical"),
        a.address_key("v", "zip").alias("address_key"),
        a.without_trailing_unit("v").alias("no_unit"),
    )


@workload(f"""
    WITH r AS (
        SELECT c_custkey, '  ' || c_name || '   of  ' || c_mktsegment || ' ' AS spaced,
               'WA 98' || lpad(CAST(100 + c_custkey % 100 AS VARCHAR), 3, '0') || '-1234' AS postal,
               CASE c_custkey % 7 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN '' WHEN 3 THEN 'Y' WHEN 4 THEN '0' ELSE c_mktsegment END AS flag,
               CASE c_custkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'short  sale' WHEN 2 THEN 'Other - ' || c_name WHEN 3 THEN '' ELSE 'Otherwise' END AS approval,
               CASE c_custkey % 6 WHEN 0 THEN '32 - Townhouse' WHEN 1 THEN 'CONDO' WHEN 2 THEN 'multi unit' WHEN 3 THEN 'Floating' WHEN 4 THEN '' ELSE c_mktsegment END AS style
        FROM customer),
    z AS (SELECT *, regexp_extract(postal, '[0-9]{{5}}') AS zip FROM r)
    SELECT c_custkey, trim(regexp_replace(spaced, '\\s+', ' ', 'g')) AS squeezed, zip,
           coalesce({sql_case("zip", p.COUNTY_NEIGHBORHOODS)}, '') AS county_place,
           coalesce({sql_case("zip", p.ENRICHMENT_NEIGHBORHOODS)}, '') AS listing_place,
           CASE WHEN lower(flag) IN ('true', 'yes', 'y', '1') THEN 'true' WHEN lower(flag) IN ('false', 'no', 'n', '0') THEN 'false' ELSE flag END AS flag_text,
           CASE WHEN lower(approval) = 'none' THEN 'None' WHEN lower(regexp_replace(approval, '\\s+', ' ', 'g')) = 'short sale' THEN 'Short Sale'
                WHEN regexp_matches(lower(approval), '^other\\b') THEN 'Other - See Remarks' ELSE approval END AS approval_text,
           CASE WHEN contains(lower(style), 'townhouse') THEN 'Townhouse' WHEN contains(lower(style), 'condo') THEN 'Condo'
                WHEN contains(lower(style), 'multi') THEN 'Multi-Family' WHEN contains(lower(style), 'floating') THEN 'Floating Home' ELSE 'Single Family' END AS style_type
    FROM z""")
def text_scalars(spark, sf):
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    pick = lambda m, *values: _pick(key % m, values)
    r = table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit("  "), "c_name", F.lit("   of  "), segment, F.lit(" ")).alias("spaced"),
        F.concat(F.lit("WA 98"), F.lpad((100 + key % 100).cast("string"), 3, "0"), F.lit("-1234")).alias("postal"),
        pick(7, "TRUE", "no", "", "Y", "0", segment).alias("flag"),
        pick(5, "NONE", "short  sale", F.concat(F.lit("Other - "), "c_name"), "", "Otherwise").alias("approval"),
        pick(6, "32 - Townhouse", "CONDO", "multi unit", "Floating", "", segment).alias("style"),
    )
    return r.select(
        "c_custkey",
        t.squeezed("spaced").alias("squeezed"),
        t.zip5("postal").alias("zip"),
        F.coalesce(p.county_neighborhood("postal"), F.lit("")).alias("county_place"),
        F.coalesce(p.enrichment_neighborhood("postal"), F.lit("")).alias("listing_place"),
        t.boolean_text("flag").alias("flag_text"),
        t.approval_text("approval").alias("approval_text"),
        t.type_from_style("style").alias("style_type"),
    )


def _pick(key, values):
    """The i-th value for key i, the last one for all others."""
    as_value = lambda v: F.lit(v) if isinstance(v, str) else v
    result = None
    for i, v in enumerate(values[:-1]):
        result = F.when(key == i, as_value(v)) if result is None else result.when(key == i, as_value(v))
    return result.otherwise(as_value(values[-1]))


@workload("""
    WITH r AS (
        SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'P.O. Box ' || CAST(s_suppkey AS VARCHAR) WHEN 1 THEN '' ELSE CAST(s_suppkey AS VARCHAR) || ' Mail St,' END AS line,
               CASE WHEN s_nationkey % 2 = 0 THEN 'SEATTLE WA' ELSE 'KENT WA' END AS city,
               CASE WHEN s_nationkey % 2 = 0 THEN '98103' ELSE '98030' END AS zip,
               CASE s_suppkey % 3 WHEN 0 THEN '' ELSE CAST(s_suppkey AS VARCHAR) || ' Site Ave 98101' END AS site,
               CASE s_suppkey % 5 WHEN 0 THEN '98030' WHEN 1 THEN '' ELSE '98102' END AS site_zip
        FROM supplier),
    c AS (
        SELECT *, trim(regexp_replace(regexp_replace(line, ',\\s*$', ''), '\\b[0-9]{5}(?:-[0-9]{4})?\\s*$', '')) AS mail,
               trim(regexp_replace(regexp_replace(site, ',\\s*$', ''), '\\b[0-9]{5}(?:-[0-9]{4})?\\s*$', '')) AS place
        FROM r),
    g AS (
        SELECT *, regexp_matches(place, '^[0-9]') AND regexp_matches(place, '[A-Za-z]') AS site_good,
               regexp_matches(mail, '^[0-9]') AND regexp_matches(mail, '[A-Za-z]') AS mail_good,
               site_zip = '' OR starts_with(site_zip, '981') AS site_inside,
               CASE WHEN line = '' THEN city || ', ' || zip ELSE line || ', ' || city || ', ' || zip END AS mail_text,
               CASE WHEN place = '' THEN '' ELSE place || ', Seattle' || CASE WHEN site_zip <> '' THEN ' ' || site_zip ELSE '' END END AS site_text
        FROM c),
    chosen AS (
        SELECT s_suppkey,
               CASE WHEN site_good AND site_inside THEN site_text WHEN mail_good THEN trim(mail || ', ' || city || ' ' || zip)
                    WHEN site_good THEN site_text ELSE mail_text END AS address,
               CASE WHEN site_good AND site_inside THEN 'SITUS_PROXY' WHEN mail_good THEN 'MAILING_STREET'
                    WHEN site_good THEN 'SITUS_PROXY' ELSE 'MAILING_FALLBACK' END AS source,
               CASE WHEN site_good AND (site_inside OR NOT mail_good) THEN coalesce(nullif(site_zip, ''), zip) ELSE zip END AS postal
        FROM g)
    SELECT s_suppkey, address, source, postal,
           CASE WHEN source = 'SITUS_PROXY' OR (source = 'MAILING_STREET' AND (starts_with(postal, '981') OR regexp_matches(lower(address), '\\bseattle\\b'))) THEN 1 ELSE 0 END AS trusted
    FROM chosen""")
def address_choice(spark, sf):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    text = key.cast("string")
    r = table(spark, sf, "supplier").select(
        "s_suppkey",
        _pick(key % 4, [F.concat(F.lit("P.O. Box "), text), "", F.concat(text, F.lit(" Mail St,"))]).alias("line"),
        F.when(nation % 2 == 0, "SEATTLE WA").otherwise("KENT WA").alias("city"),
        F.when(nation % 2 == 0, "98103").otherwise("98030").alias("zip"),
        _pick(key % 3, ["", F.concat(text, F.lit(" Site Ave 98101"))]).alias("site"),
        _pick(key % 5, ["98030", "", "98102"]).alias("site_zip"),
    )
    r = r.withColumn("text", a.mailing_address("line", "city", "zip"))
    r = a.with_chosen_address(r, "line", "city", "zip", "text", "site", "site_zip", "c")
    return r.select(
        "s_suppkey",
        F.col("c.address").alias("address"),
        F.col("c.source").alias("source"),
        F.col("c.zip").alias("postal"),
        a.trusted_address(F.col("c.address"), F.col("c.source"), F.col("c.zip")).cast("int").alias("trusted"),
    )


@workload(f"""
    WITH m AS (
        SELECT event_id, CASE WHEN value < 5 THEN 0.0 ELSE value END AS value, CASE event_type WHEN 'view' THEN '' ELSE event_type END AS kind,
               CASE WHEN user_id % 2 = 0 THEN NULL ELSE user_id END AS who, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE props END AS props
        FROM events)
    SELECT event_id, CAST((value <> 0)::INT + (trim(kind) <> '')::INT + (coalesce(who, 0) <> 0)::INT + (trim(props) <> '')::INT AS INTEGER) AS present,
           {sql_cents("value")} AS value_cents
    FROM m""")
def completeness_count(spark, sf):
    e = table(spark, sf, "events")
    m = e.select(
        "event_id",
        F.when(F.col("value") < 5, F.lit(0.0)).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("kind"),
        F.when(F.col("user_id") % 2 != 0, F.col("user_id")).alias("who"),
        F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("props")).alias("props"),
    )
    return m.select(
        "event_id", count_present(m, ["value", "kind", "who", "props"]).alias("present"), cents("value").alias("value_cents")
    )


@workload("""
    SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'Cental Seattle Stats 2_9 to 3_20.csv' WHEN 1 THEN 'Sold And Stats - QA.csv'
             WHEN 2 THEN s_name || ' Rich Snapshot.csv' WHEN 3 THEN 'NW.csv' WHEN 4 THEN 'Stats.csv' ELSE 'North_' || s_name || ' full.CSV' END AS file,
           CASE s_suppkey % 6 WHEN 0 THEN 'Central Seattle' WHEN 1 THEN 'QA Magnolia' WHEN 2 THEN s_name WHEN 3 THEN 'NW Seattle' WHEN 4 THEN 'Seattle'
             ELSE 'North ' || s_name END AS region
    FROM supplier""")
def region_names(spark, sf):
    key, name = F.col("s_suppkey"), F.col("s_name")
    files = _pick(
        key % 6,
        [
            "Cental Seattle Stats 2_9 to 3_20.csv", "Sold And Stats - QA.csv", F.concat(name, F.lit(" Rich Snapshot.csv")),
            "NW.csv", "Stats.csv", F.concat(F.lit("North_"), name, F.lit(" full.CSV")),
        ],
    )
    f = table(spark, sf, "supplier").select("s_suppkey", files.alias("file"))
    return f.select("s_suppkey", "file", t.region_from_name("file").alias("region"))
