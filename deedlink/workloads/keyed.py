"""Filters, lookups, aggregates and order-dependent operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from deedlink.functions.dates import in_rolling_year
from deedlink.functions.presence import count_present
from deedlink.functions.text import status_rank
from deedlink.operators import aggregates as a
from deedlink.operators.dedupe import collapse_snapshots, freshness
from deedlink.operators.ordering import with_fragment, with_group_position, with_position
from deedlink.functions.address import address_key
from deedlink.operators.resolve import Lookup, county_addresses, previous_parcels, resolve_by_cascade, resolve_listings, wanted_addresses
from deedlink.sources.coordinates import inside_box, parcel_points
from deedlink.functions.keys import major_of, minor_of
from deedlink.workloads.registry import cents, day, day_text, sql_cents, sql_day_text, table, workload

#: Last order date of the tables; the rolling year ends here.
AS_OF = dt.date(2001, 8, 1)
YEAR_START = dt.date(2000, 8, 1)


@workload(f"""
    SELECT o_orderkey, o_custkey, {sql_cents("o_totalprice")} AS price_cents, {sql_day_text("o_orderdate")} AS ordered
    FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{YEAR_START}' AND DATE '{AS_OF}'""")
def rolling_window(spark, sf):
    o = table(spark, sf, "orders").filter(in_rolling_year(day("o_orderdate"), F.lit(AS_OF)))
    return o.select("o_orderkey", "o_custkey", cents("o_totalprice").alias("price_cents"), day_text("o_orderdate").alias("ordered"))


@workload(f"""
    SELECT c_custkey, c_name, coalesce(r_name, '') AS r_name, {sql_cents("c_acctbal")} AS balance_cents
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN region ON r_regionkey = n_regionkey AND upper(r_name) = 'ASIA'
    WHERE (r_regionkey IS NOT NULL OR contains(upper(c_mktsegment), 'BUILD')) AND c_acctbal > 0""")
def in_scope_filter(spark, sf):
    region = table(spark, sf, "region").filter(F.upper("r_name") == "ASIA")
    places = table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    c = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0)
    scoped = c.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").filter(
        F.col("r_regionkey").isNotNull() | F.upper("c_mktsegment").contains("BUILD")
    )
    return scoped.select("c_custkey", "c_name", F.coalesce("r_name", F.lit("")).alias("r_name"), cents("c_acctbal").alias("balance_cents"))


@workload(f"""
    SELECT o_orderstatus, coalesce(p_brand, 'none') AS brand, coalesce(s_nationkey, -1) AS supplier_nation,
           count(*) AS lines, CAST(sum({sql_cents("l_extendedprice")}) AS BIGINT) AS price_cents, count(s_suppkey) AS with_supplier
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey
    LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 3000) ON s_suppkey = l_suppkey
    GROUP BY ALL""")
def lookup_chain(spark, sf):
    # both tables are read whole, rows that don't count have no value
    part = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("p_brand"))
    rich = lambda c: F.when(F.col("s_acctbal") > 3000, F.col(c))
    supplier = table(spark, sf, "supplier").select("s_suppkey", rich("s_nationkey").alias("s_nationkey"), rich("s_suppkey").alias("rich"))
    joined = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    )
    return joined.groupBy(
        "o_orderstatus",
        F.coalesce("p_brand", F.lit("none")).alias("brand"),
        F.coalesce("s_nationkey", F.lit(-1)).alias("supplier_nation"),
    ).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(cents("l_extendedprice")).alias("price_cents"),
        F.count("rich").alias("with_supplier"),
    )


@workload("""
    WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY ALL),
    l AS (SELECT c_nationkey, c_mktsegment AS label FROM n QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, first) = 1)
    SELECT c_custkey, c_nationkey, label, CASE WHEN label = c_mktsegment THEN 1 ELSE 0 END AS agrees
    FROM customer LEFT JOIN l USING (c_nationkey)""")
def learned_label(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    labels = a.learned_label(c, ["c_nationkey"], "c_mktsegment", "c_custkey", "label")
    return c.join(labels, "c_nationkey", "left").select(
        "c_custkey", "c_nationkey", "label", (F.col("label") == F.col("c_mktsegment")).cast("int").alias("agrees")
    )


@workload(f"""
    SELECT o_custkey, o_orderkey, o_orderstatus, {sql_cents("o_totalprice")} AS price_cents FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def argmax_record(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    best = a.best_record(o, ["o_custkey"], "o_totalprice", "o_orderkey")
    return best.select("o_custkey", "o_orderkey", "o_orderstatus", cents("o_totalprice").alias("price_cents"))


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@workload(f"""
    WITH lists AS (
        SELECT l_suppkey, list({{'size': l_quantity, 'flag': l_returnflag = 'R', 'day': l_shipdate, 'order': l_orderkey, 'line': l_linenumber}}
                               ORDER BY {", ".join(LINE_ORDER)}) AS rows
        FROM lineitem GROUP BY l_suppkey),
    folded AS (
        SELECT l_suppkey, list_reduce(rows, lambda kept, r: CASE WHEN r.size > kept.size OR (r.flag AND NOT kept.flag) THEN r ELSE kept END) AS r
        FROM lists)
    SELECT l_suppkey, r.size AS quantity, CASE WHEN r.flag THEN 1 ELSE 0 END AS flagged, {sql_day_text("r.day")} AS shipped, r."order" AS l_orderkey, r.line AS l_linenumber
    FROM folded""")
def ordered_fold(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", *LINE_ORDER)
    # fragments by rank: a supplier with a third of all rows on one day is cut like any other
    lines = with_fragment(lines, ["l_suppkey"], LINE_ORDER).drop("l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    kept = a.ordered_fold(lines, ["l_suppkey"], "l_quantity", F.col("l_returnflag") == "R", "position", "fragment")
    return kept.select(
        "l_suppkey",
        F.col("l_quantity").alias("quantity"),
        (F.col("l_returnflag") == "R").cast("int").alias("flagged"),
        day_text("l_shipdate").alias("shipped"),
        "l_orderkey",
        "l_linenumber",
    )


@workload("""
    SELECT user_id, arg_min(event_type, {'t': ts, 'e': event_id}) AS first_type, arg_max(event_type, {'t': ts, 'e': event_id}) AS last_type,
           arg_min(event_id, {'t': ts, 'e': event_id}) AS first_event, arg_max(event_id, {'t': ts, 'e': event_id}) AS last_event
    FROM events GROUP BY user_id""")
def first_last_value(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("pos"))
    first = a.first_value(e, ["user_id"], ["event_type", "event_id"], "pos")
    last = a.last_value(e, ["user_id"], ["event_type", "event_id"], "pos")
    return first.toDF("user_id", "first_type", "first_event").join(last.toDF("user_id", "last_type", "last_event"), "user_id")


@workload(f"""
    WITH o AS (
        SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS priority,
               CASE WHEN o_totalprice < 250000 THEN 0.0 ELSE o_totalprice END AS price, CASE WHEN o_orderstatus = 'O' THEN ' ' ELSE o_orderstatus END AS status
        FROM orders)
    SELECT o_custkey, coalesce(arg_min(priority, o_orderkey) FILTER (trim(priority) <> ''), '') AS priority,
           coalesce(arg_min(status, o_orderkey) FILTER (trim(status) <> ''), '') AS status,
           coalesce(arg_min({sql_cents("price")}, o_orderkey) FILTER (price <> 0), 0) AS price_cents
    FROM o GROUP BY o_custkey""")
def first_present_snapshot(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_totalprice") < 250000, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.col("o_orderstatus")).alias("status"),
    )
    s = a.first_present(o, ["o_custkey"], ["priority", "status", "price"], "o_orderkey")
    return s.select(
        "o_custkey",
        F.coalesce("priority", F.lit("")).alias("priority"),
        F.coalesce("status", F.lit("")).alias("status"),
        F.coalesce(cents("price"), F.lit(0)).alias("price_cents"),
    )


EVENT_RANK = {"ERROR": 700, "PURCHASE": 600, "CLICK": 100}
# snapshots of a user and hour, some fields blanked by fixed rules
SNAPSHOT_SQL = """
    SELECT event_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS thing, event_type AS status, CAST(ts AS DATE) AS seen,
           CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS value, CASE WHEN event_id % 4 < 2 THEN '' ELSE props END AS props,
           CASE WHEN event_type = 'view' THEN NULL ELSE event_id % 50 END AS score
    FROM events"""
RANK_SQL = """{'a': -CASE upper(status) WHEN 'ERROR' THEN 700 WHEN 'PURCHASE' THEN 600 WHEN 'CLICK' THEN 100 ELSE 0 END,
    'b': -CAST(strftime(seen, '%Y%m%d') AS BIGINT), 'c': -((value <> 0)::INT + (props <> '')::INT + (coalesce(score, 0) <> 0)::INT), 'd': event_id}"""


@workload(f"""
    WITH s AS ({SNAPSHOT_SQL}), r AS (SELECT *, {RANK_SQL} AS rank FROM s)
    SELECT thing, arg_min(event_id, rank) AS event_id, arg_min(status, rank) AS status,
           {sql_cents("coalesce(arg_min(value, rank) FILTER (value <> 0), 0)")} AS value_cents,
           coalesce(arg_min(props, rank) FILTER (props <> ''), '') AS props,
           CAST(coalesce(arg_min(score, rank) FILTER (coalesce(score, 0) <> 0), arg_min(coalesce(score, -1), rank)) AS BIGINT) AS score, min(event_id) AS group_order
    FROM r GROUP BY thing""")
def ranked_fill_dedupe(spark, sf):
    s = _snapshots(spark, sf)
    rank = F.struct(
        -status_rank("status", EVENT_RANK),
        -freshness("seen", "seen"),
        -count_present(s, ["value", "props", "score"]),
        F.col("event_id"),
    )
    rows = collapse_snapshots(s, "thing", "event_id", rank, ["value", "props", "score"]).rows
    return rows.select(
        "thing",
        "event_id",
        "status",
        cents("value").alias("value_cents"),
        "props",
        F.coalesce("score", F.lit(-1)).alias("score"),
        "group_order",
    )


def _snapshots(spark, sf):
    e, key = table(spark, sf, "events"), F.col("event_id")
    return e.select(
        "event_id",
        F.concat_ws("/", "user_id", day_text("ts")).alias("thing"),
        F.col("event_type").alias("status"),
        day("ts").alias("seen"),
        F.when(key % 3 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("value"),
        F.when(key % 4 < 2, "").otherwise(F.col("props")).alias("props"),
        F.when(F.col("event_type") != "view", key % 50).alias("score"),
    )


@workload(f"""
    WITH o AS (SELECT o_orderkey, o_custkey || '/' || year(o_orderdate) AS thing, o_orderstatus, {sql_cents("o_totalprice")} AS price_cents FROM orders),
    g AS (SELECT thing, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds, min(o_orderkey) AS first FROM o GROUP BY thing),
    kept AS (SELECT o.thing, o_orderkey, price_cents, first AS group_order FROM o JOIN g USING (thing) WHERE n = 1 OR kinds > 1),
    merged AS (SELECT o.thing, arg_max(o_orderkey, {{'p': price_cents, 'k': -o_orderkey}}) AS o_orderkey, max(price_cents) AS price_cents, min(o_orderkey) AS group_order
               FROM o JOIN g USING (thing) WHERE n > 1 AND kinds = 1 GROUP BY o.thing)
    SELECT * FROM kept UNION ALL SELECT * FROM merged""")
def conflict_guard(spark, sf):
    rows = _yearly_orders(spark, sf).rows
    return rows.select("thing", "o_orderkey", "price_cents", "group_order")


@workload("""
    WITH g AS (SELECT o_custkey || '/' || year(o_orderdate) AS thing, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY ALL)
    SELECT count(*) FILTER (n > 1 AND kinds = 1) AS "duplicateListings", CAST(coalesce(sum(n - 1) FILTER (n > 1 AND kinds = 1), 0) AS BIGINT) AS "duplicateRowsCollapsed",
           count(*) FILTER (n > 1 AND kinds > 1) AS "conflictListings", CAST(coalesce(sum(n) FILTER (n > 1 AND kinds > 1), 0) AS BIGINT) AS "conflictRows"
    FROM g""")
def conflict_counts(spark, sf):
    return _yearly_orders(spark, sf).counts


def _yearly_orders(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat_ws("/", "o_custkey", F.year("o_orderdate")).alias("thing"),
        "o_orderstatus",
        cents("o_totalprice").alias("price_cents"),
    )
    rank = F.struct(-F.col("price_cents"), F.col("o_orderkey"))
    return collapse_snapshots(o, "thing", "o_orderkey", rank, ["price_cents"], F.col("o_orderstatus"))


@workload("""
    WITH u AS (SELECT p_name, p_brand, min(p_partkey) AS only_key FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) = 1)
    SELECT p_partkey, coalesce(only_key, -1) AS only_key FROM part LEFT JOIN u USING (p_name, p_brand)""")
def unique_lookup(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    only = a.unique_value(part, ["p_name", "p_brand"], "p_partkey", "only_key")
    return part.join(only, ["p_name", "p_brand"], "left").select("p_partkey", F.coalesce("only_key", F.lit(-1)).alias("only_key"))


CASCADE_KEYS = {
    "whole": ["p_name", "p_brand", "p_type", "p_size"],
    "no_type": ["p_name", "p_brand", "p_size"],
    "name_brand": ["p_name", "p_brand"],
}


def _cascade_sql():
    lookups, joins = [], []
    for name, keys in CASCADE_KEYS.items():
        cols = ", ".join(keys)
        lookups.append(f"{name} AS (SELECT {cols}, min(p_partkey) AS {name}_key FROM part GROUP BY {cols} HAVING min(p_partkey) = max(p_partkey))")
        joins.append(f"LEFT JOIN {name} USING ({cols})")
    found = [f"{n}_key" for n in CASCADE_KEYS]
    methods = " ".join(f"WHEN {n}_key IS NOT NULL THEN '{n}'" for n in CASCADE_KEYS)
    return f"""
        WITH {", ".join(lookups)},
        lines AS (SELECT l_orderkey, l_linenumber, l_returnflag, p_partkey, p_name, p_brand, p_type, p_size FROM lineitem JOIN part ON p_partkey = l_partkey),
        resolved AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'own' {methods} ELSE 'unresolved' END AS method,
                            CASE WHEN l_returnflag = 'R' THEN p_partkey ELSE coalesce({", ".join(found)}) END AS key, l_orderkey
                     FROM lines {" ".join(joins)})
        SELECT method, count(*) AS rows, CAST(coalesce(sum(key), 0) AS BIGINT) AS key_sum, CAST(sum(l_orderkey) AS BIGINT) AS order_sum FROM resolved GROUP BY method"""


@workload(_cascade_sql())
def resolution_cascade(spark, sf):
    part = table(spark, sf, "part")
    described = {n: F.concat_ws("|", *k) for n, k in CASCADE_KEYS.items()}
    lines = (
        table(spark, sf, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_orderkey",
            F.when(F.col("l_returnflag") == "R", F.col("p_partkey").cast("string")).alias("key"),
            *[c.alias(n) for n, c in described.items()],
        )
    )
    lookups = [
        Lookup(n, a.unique_value(part.select(c.alias("key"), F.col("p_partkey").cast("string").alias("value")), ["key"], "value"), n)
        for n, c in described.items()
    ]
    resolved = resolve_by_cascade(lines, "key", lookups, "own")
    return resolved.groupBy(F.coalesce("method", F.lit("unresolved")).alias("method")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.col("key").cast("long")), F.lit(0)).alias("key_sum"),
        F.sum("l_orderkey").alias("order_sum"),
    )


# county rows out of suppliers (buildings) and customers (accounts), listings out of orders: streets that need no rewriting
BUILDING_SQL = """SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS apn, (s_suppkey % 90) || ' ' || CASE WHEN s_suppkey % 3 = 0 THEN '1/2 ' ELSE '' END || 'OAK ST|98101' AS exact,
    (s_suppkey % 90) || ' OAK ST|98101' AS no_unit FROM supplier"""
ACCOUNT_SQL = """SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS apn, (c_custkey % 1100) || ' OAK ST' || CASE WHEN c_custkey % 4 = 0 THEN ' UNIT ' || (c_custkey % 9) ELSE '' END || '|98101' AS exact,
    (c_custkey % 1100) || ' OAK ST|98101' AS no_unit FROM customer"""
LISTING_SQL = """SELECT o_orderkey, 'L' || o_orderkey AS listing, CASE WHEN o_orderstatus = 'F' THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0') ELSE '' END AS apn,
    CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 95) || ' 1/2 OAK ST|98101' WHEN 1 THEN (o_orderkey % 1300) || ' OAK ST UNIT ' || (o_orderkey % 9) || '|98101' ELSE (o_orderkey % 900) || ' OAK ST|98101' END AS exact,
    CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 95) WHEN 1 THEN (o_orderkey % 1300) ELSE (o_orderkey % 900) END || ' OAK ST|98101' AS no_unit FROM orders"""
ADDRESS_CTES = f"""b AS ({BUILDING_SQL}), a AS ({ACCOUNT_SQL}), l AS ({LISTING_SQL}),
    wanted AS (SELECT DISTINCT 'exact' AS level, exact AS key FROM l WHERE apn = '' UNION SELECT DISTINCT 'no_unit', no_unit FROM l WHERE apn = ''),
    keyed AS (SELECT 'building' AS source, 'exact' AS level, exact AS key, apn FROM b UNION ALL SELECT 'building', 'no_unit', no_unit, apn FROM b
              UNION ALL SELECT 'account', 'exact', exact, apn FROM a UNION ALL SELECT 'account', 'no_unit', no_unit, apn FROM a),
    found AS (SELECT * FROM keyed SEMI JOIN wanted USING (level, key))"""


def _street(number, unit=None, middle=None):
    parts = [number.cast("string"), *([middle] if middle is not None else []), F.lit("Oak St"), *([unit] if unit is not None else [])]
    return F.concat_ws(" ", *parts)


def _county_listings(spark, sf):
    """Listings with address keys made by the package's own rules."""
    key = F.col("o_orderkey")
    number = F.when(key % 3 == 0, key % 95).when(key % 3 == 1, key % 1300).otherwise(key % 900)
    unit = F.when(key % 3 == 1, F.concat(F.lit("#"), (key % 9).cast("string")))
    half = F.when(key % 3 == 0, F.lit("1/2"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("L"), key.cast("string")).alias("listingNumber"),
        F.when(F.col("o_orderstatus") == "F", F.lpad(F.col("o_custkey").cast("string"), 10, "0")).otherwise("").alias("apn"),
        address_key(_street(number, unit, half), F.lit("98101-0001")).alias("addressKeyExact"),
        address_key(_street(number), F.lit("98101")).alias("addressKeyNoUnit"),
    )


def _county_addresses(spark, sf, listings):
    supplier, customer = F.col("s_suppkey"), F.col("c_custkey")
    major, minor = (lambda k: F.substring(F.lpad(k.cast("string"), 10, "0"), 1, 6)), (lambda k: F.substring(F.lpad(k.cast("string"), 10, "0"), 7, 4))
    buildings = table(spark, sf, "supplier").select(
        major(supplier).alias("Major"), minor(supplier).alias("Minor"), (supplier % 90).cast("string").alias("BuildingNumber"),
        F.when(supplier % 3 == 0, "1/2").otherwise("").alias("Fraction"), F.lit("").alias("DirectionPrefix"), F.lit("Oak").alias("StreetName"),
        F.lit("Street").alias("StreetType"), F.lit("").alias("DirectionSuffix"), F.lit("98101").alias("ZipCode"),
    )
    unit = F.when(customer % 4 == 0, F.concat(F.lit("#"), (customer % 9).cast("string")))
    accounts = table(spark, sf, "customer").select(
        major(customer).alias("Major"), minor(customer).alias("Minor"), _street(customer % 1100, unit).alias("AddrLine"), F.lit("98101").alias("ZipCode")
    )
    return county_addresses(buildings, accounts, wanted_addresses(listings))


@workload(f"""
    WITH {ADDRESS_CTES}
    SELECT source, level, key, count(DISTINCT apn) AS parcels, min(apn) AS least FROM found GROUP BY ALL""")
def address_index(spark, sf):
    found = _county_addresses(spark, sf, _county_listings(spark, sf))
    return found.groupBy("source", "level", "key").agg(F.count_distinct("apn").alias("parcels"), F.min("apn").alias("least"))


PREVIOUS_SQL = """SELECT 'L' || c_custkey AS listing, lpad(CAST(arg_min(o_orderkey, o_orderkey) AS VARCHAR), 10, '0') AS previous
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' GROUP BY c_custkey"""


def _previous(spark, sf):
    """A previous output: listing numbers with blanks around them, of which only some rows hold a parcel."""
    usable = F.when(F.col("o_orderstatus") == "P", F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).otherwise(F.col("o_orderkey").cast("string"))
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit(" L"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("mlsListingNumber"), usable.alias("parcelNbr"), "o_orderkey"
    )
    return previous_parcels(rows, "o_orderkey")


@workload(f"""
    WITH prev AS ({PREVIOUS_SQL})
    SELECT c_custkey, coalesce(previous, '') AS previous FROM customer LEFT JOIN prev ON listing = 'L' || c_custkey""")
def previous_lookup(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("L"), F.col("c_custkey").cast("string")).alias("key"))
    return c.join(_previous(spark, sf), "key", "left").select("c_custkey", F.coalesce("value", F.lit("")).alias("previous"))


def _unique_sql(name: str, source: str, level: str) -> str:
    return f"{name} AS (SELECT key, min(apn) AS {name} FROM found WHERE source = '{source}' AND level = '{level}' GROUP BY key HAVING min(apn) = max(apn))"


LISTING_STEPS = [("be", "building", "exact"), ("ae", "account", "exact"), ("bn", "building", "no_unit"), ("an", "account", "no_unit")]


@workload(f"""
    WITH {ADDRESS_CTES}, prev AS ({PREVIOUS_SQL}), {", ".join(_unique_sql(*s) for s in LISTING_STEPS)}
    SELECT o_orderkey, coalesce(nullif(l.apn, ''), previous, be, ae, bn, an, '') AS apn,
           CASE WHEN l.apn <> '' THEN 'REALTOR_APN' WHEN previous IS NOT NULL THEN 'PREVIOUS_ENRICHED_LISTING_NUMBER' WHEN be IS NOT NULL THEN 'COUNTY_RESBLDG_EXACT'
                WHEN ae IS NOT NULL THEN 'COUNTY_ACCOUNT_EXACT' WHEN bn IS NOT NULL THEN 'COUNTY_RESBLDG_NO_UNIT' WHEN an IS NOT NULL THEN 'COUNTY_ACCOUNT_NO_UNIT' ELSE '' END AS method
    FROM l LEFT JOIN prev USING (listing) LEFT JOIN be ON be.key = exact LEFT JOIN ae ON ae.key = exact LEFT JOIN bn ON bn.key = no_unit LEFT JOIN an ON an.key = no_unit""")
def listing_resolution(spark, sf):
    """Missing parcels through all steps of the cascade."""
    listings = _county_listings(spark, sf)
    resolved = resolve_listings(listings, _previous(spark, sf), _county_addresses(spark, sf, listings))
    return resolved.select("o_orderkey", F.coalesce("apn", F.lit("")).alias("apn"), F.coalesce("apnResolutionMethod", F.lit("")).alias("method"))


@workload("""
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
    WHERE l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 20000 AND 50000""")
def bbox_filter(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return lines.filter(inside_box("l_quantity", "l_extendedprice", (10.0, 20.0, 20000.0, 50000.0)))


# points out of accounts: some numbers too short, several rows per parcel, some outside the box
POINT_SQL = """SELECT c_custkey, CAST(c_custkey % 400 * 7654321 + CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 1000000000 END AS VARCHAR) AS parcel,
    CAST(46 + c_acctbal / 2500 AS VARCHAR) AS lat, CAST(-124 + c_nationkey / 8.0 AS VARCHAR) AS lon FROM customer"""


@workload(f"""
    WITH p AS ({POINT_SQL}),
    usable AS (SELECT c_custkey, right(parcel, 10) AS parcel, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM p WHERE length(parcel) >= 10),
    inside AS (SELECT * FROM usable WHERE lat BETWEEN 46 AND 49 AND lon BETWEEN -123.5 AND -121.5)
    SELECT left(parcel, 6) AS major, right(parcel, 4) AS minor, arg_min(lat, c_custkey) AS first_lat, arg_max(lat, c_custkey) AS last_lat,
           arg_min(lon, c_custkey) AS first_lon, arg_max(lon, c_custkey) AS last_lon
    FROM inside GROUP BY parcel""")
def coordinate_lookup(spark, sf):
    key = F.col("c_custkey")
    number = key % 400 * 7654321 + F.when(key % 11 == 0, 0).otherwise(1000000000)
    rows = table(spark, sf, "customer").select(
        number.cast("string").alias("parcel"),
        (46 + F.col("c_acctbal") / 2500).cast("string").alias("lat"),
        (-124 + F.col("c_nationkey") / 8.0).cast("string").alias("lon"),
        key.alias("ord"),
    )
    points = parcel_points(rows, has_parts=False)
    first = a.first_value(points, ["parcel"], ["lat", "lon"], "ord").toDF("parcel", "first_lat", "first_lon")
    last = a.last_value(points, ["parcel"], ["lat", "lon"], "ord").toDF("parcel", "last_lat", "last_lon")
    both = first.join(last, "parcel")
    return both.select(major_of("parcel").alias("major"), minor_of("parcel").alias("minor"), *both.columns[1:]).orderBy("major", "minor")


@workload("""
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position,
           row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS position_in_status
    FROM orders""")
def row_positions(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    placed = with_position(o, ["o_orderdate", "o_orderkey"])
    grouped = with_group_position(placed, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], "position_in_status")
    return grouped.select("o_orderkey", "position", "position_in_status")


@workload("""
    SELECT l_suppkey, l_returnflag, count(*) AS lines FROM lineitem GROUP BY ALL""")
def nested_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("lines"))


@workload("""
    WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, event_type, n AS events, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS all_events FROM s""")
def distinct_values_per_key(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("events"))
    # one row per user and type, so the window sees as many rows per user as there are types
    return per.withColumn("all_events", F.sum("events").over(Window.partitionBy("user_id")))

