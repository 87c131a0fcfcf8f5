"""Validation counts, canonical fields, filters, key figures, bids and projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from deedlink.functions.text import status_text
from deedlink.operators import bids as b
from deedlink.operators import filters as f
from deedlink.operators.aggregates import group_counts
from deedlink.operators.validate import output_counts, rule_results
from deedlink.operators.enrich import ENRICHED
from deedlink.workloads.registry import cents, day, day_text, sql_cents, sql_day_text, table, workload


@workload("""
    SELECT CASE WHEN coalesce(mode, '') = '' THEN 'UNKNOWN' ELSE mode END AS mode, count(*) AS rows
    FROM (SELECT CASE o_orderpriority WHEN '5-LOW' THEN '' WHEN '3-MEDIUM' THEN NULL ELSE o_orderpriority END AS mode FROM orders) GROUP BY 1""")
def mode_counts(spark, sf):
    p = F.col("o_orderpriority")
    mode = F.when(p == "5-LOW", "").when(p == "3-MEDIUM", F.lit(None).cast("string")).otherwise(p)
    return group_counts(table(spark, sf, "orders").select(mode.alias("mode")), "mode")


# orders seen as output rows: mode by priority, status by order status, prices as text
OUTPUT_SQL = """
    SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'MLS_ENRICHED' ELSE 'PUBLIC_PROXY' END AS mode,
           CASE o_orderstatus WHEN 'O' THEN ' active ' WHEN 'F' THEN 'Sold' ELSE 'Pending' END AS status,
           CASE o_orderstatus WHEN 'F' THEN o_totalprice ELSE 0.0 END AS close,
           CASE WHEN o_custkey % 3 = 0 THEN o_totalprice END AS ask, CASE WHEN o_custkey % 50 = 1 THEN 0.0 ELSE o_totalprice END AS list
    FROM orders"""
COUNTS_SQL = f"""
    SELECT count(*) AS "outputRows", count(*) FILTER (mode = 'MLS_ENRICHED') AS "mlsRows",
           count(*) FILTER (mode = 'MLS_ENRICHED' AND close > 0) AS "mlsSoldRows", count(*) FILTER (mode = 'MLS_ENRICHED' AND close <= 0) AS "mlsOpenRows",
           count(*) FILTER (mode = 'MLS_ENRICHED' AND close <= 0 AND upper(trim(status)) = 'ACTIVE') AS "mlsActiveRows",
           count(*) FILTER (mode = 'MLS_ENRICHED' AND close <= 0 AND upper(trim(status)) = 'ACTIVE' AND coalesce(ask, list) <= 0) AS "activeMissingAsk"
    FROM ({OUTPUT_SQL})"""


def _output_rows(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    status, price, cust = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_custkey")
    return o.select(
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "MLS_ENRICHED").otherwise("PUBLIC_PROXY").alias("mode"),
        F.when(status == "O", " active ").when(status == "F", "Sold").otherwise("Pending").alias("status"),
        F.when(status == "F", price).otherwise(F.lit(0.0)).cast("string").alias("close"),
        F.when(cust % 3 == 0, price).cast("string").alias("ask"),
        F.when(cust % 50 == 1, F.lit(0.0)).otherwise(price).cast("string").alias("list"),
    )


@workload(COUNTS_SQL)
def validation_counts(spark, sf):
    return output_counts(_output_rows(spark, sf), "mode", status="status", close="close", asks=("ask", "list"))


@workload(f"""
    WITH c AS ({COUNTS_SQL})
    SELECT 'active_without_ask' AS rule, 'error' AS level, "activeMissingAsk" > 0 AS failed, "activeMissingAsk" AS seen FROM c
    UNION ALL SELECT 'no_enriched_rows', 'error', "mlsRows" = 0, "mlsRows" FROM c
    UNION ALL SELECT 'no_sold_rows', 'warning', "mlsSoldRows" = 0, "mlsSoldRows" FROM c""")
def validation_report(spark, sf):
    return rule_results(validation_counts(spark, sf))


BUCKET_SQL = """CASE WHEN ratio < 0.9 THEN '<0.90x' WHEN ratio < 1.0 THEN '0.90x-1.00x' WHEN ratio < 1.1 THEN '1.00x-1.10x'
    WHEN ratio < 1.2 THEN '1.10x-1.20x' WHEN ratio >= 1.2 THEN '>=1.20x' ELSE 'unknown' END"""


@workload(f"""
    WITH r AS (SELECT s_nationkey, CASE WHEN l_tax = 0 THEN NULL ELSE 0.8 + l_discount * 5 + l_tax / 10 END AS ratio FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
    SELECT n_name, {BUCKET_SQL} AS bucket, count(*) AS rows FROM r JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""")
def geo_ratio_buckets(spark, sf):
    ratio = F.when(F.col("l_tax") != 0, 0.8 + F.col("l_discount") * 5 + F.col("l_tax") / 10)
    lines = table(spark, sf, "lineitem").select("l_suppkey", ratio.alias("ratio"))
    places = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = lines.join(places.select("s_suppkey", "n_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return f.ratio_map(joined, ["n_name"], "ratio")


@workload(f"""
    WITH l AS (SELECT l_returnflag, l_linestatus, {sql_cents("l_extendedprice")} AS price, CAST(l_quantity AS BIGINT) AS quantity
               FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND l_linenumber IN (1, 2, 3))
    SELECT l_returnflag, l_linestatus, count(*) AS rows, min(price) AS least, max(price) AS largest, CAST(sum(quantity) AS BIGINT) AS sum_quantity,
           quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS p75
    FROM l GROUP BY ALL""")
def kpi_summary(spark, sf):
    lines = table(spark, sf, "lineitem").filter(f.conjunction({"l_quantity": (5, 45), "l_linenumber": [1, 2, 3]}))
    typed = lines.select("l_returnflag", "l_linestatus", cents("l_extendedprice").alias("price"), F.col("l_quantity").cast("long").alias("quantity"))
    return f.key_figures(typed, ["l_returnflag", "l_linestatus"], "price", ["quantity"])


@workload("""
    SELECT o_orderkey, o_orderpriority FROM orders
    WHERE o_totalprice BETWEEN 110000 AND 140000 AND o_orderstatus = 'F'""")
def default_filters(spark, sf):
    chosen = f.apply_filters(table(spark, sf, "orders"), {"o_orderstatus": "F", "o_totalprice": (110000, 140000)})
    return chosen.select("o_orderkey", "o_orderpriority")


@workload("""
    SELECT event_id, CASE WHEN event_type = 'error' OR (event_type = 'click' AND value > 20) THEN 1 ELSE 0 END AS special FROM events""")
def special_sales(spark, sf):
    kind = F.col("event_type")
    e = table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "error", "true").otherwise("false").alias("bank"),
        F.when((kind == "click") & (F.col("value") > 20), "Short Sale").when(kind == "view", "None").otherwise("").alias("approval"),
    )
    return e.select("event_id", f.is_special_sale("bank", "approval").cast("int").alias("special"))


# line items seen as enriched rows
ENRICHED_SQL = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'N' AS enriched,
           CASE WHEN l_linestatus = 'F' THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS listed, strftime(o_orderdate, '%Y-%m-%d') AS county_day,
           CASE WHEN l_discount > 0.05 THEN 0.0 ELSE l_extendedprice END AS listing_price, CASE WHEN l_tax < 0.02 THEN 0.0 ELSE o_totalprice END AS county_price,
           CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE 0.0 END AS close, CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(l_linenumber - 4 AS VARCHAR) END AS dom,
           2000 + l_linenumber * 5 AS year, CASE WHEN l_suppkey % 3 = 0 THEN 'Townhouse row' ELSE 'plain' END AS style
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


@workload(f"""
    WITH e AS ({ENRICHED_SQL}),
    c AS (SELECT *, coalesce(nullif(listing_price, 0), nullif(county_price, 0)) AS pending, nullif(close, 0) AS close_price FROM e),
    t AS (SELECT *, dom <> '' AND coalesce(try_cast(dom AS DOUBLE), 0) <= 0 AS no_wait, coalesce(abs(close_price - pending) < 1, false) AS at_ask,
                 enriched AND coalesce(close_price > 0 AND pending > 0, false) AS sold, year >= 2023 AS new_year, contains(lower(style), 'townhouse') AS new_style FROM c),
    g AS (SELECT *, sold AND no_wait AND at_ask AND (new_year OR new_style) AS flag FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(listed, county_day) AS list_date, coalesce({sql_cents("pending")}, 0) AS pending_cents,
           coalesce({sql_cents("close_price")}, 0) AS close_cents, coalesce(close_price / pending, 0.0) AS sale_to_list, CASE WHEN flag THEN 1 ELSE 0 END AS presold,
           CASE WHEN flag THEN concat_ws('|', CASE WHEN no_wait THEN 'dom_le_0' END, CASE WHEN at_ask THEN 'sale_eq_list' END,
                CASE WHEN new_year THEN 'year_built_gte_2023' END, CASE WHEN new_style THEN 'style_new_build' END) ELSE '' END AS reason
    FROM g""")
def canonical_presold(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    text = lambda c: c.cast("string")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    zero = F.lit(0.0)
    e = rows.select(
        *key,
        F.when(F.col("l_returnflag") != "N", "MLS_ENRICHED").otherwise("PUBLIC_PROXY").alias("dataMode"),
        F.when(F.col("l_linestatus") != "F", day_text("l_shipdate")).alias("mlsListDate"),
        day_text("o_orderdate").alias("listDate"),
        text(F.when(F.col("l_discount") > 0.05, zero).otherwise(F.col("l_extendedprice"))).alias("mlsListingPrice"),
        text(F.when(F.col("l_tax") < 0.02, zero).otherwise(F.col("o_totalprice"))).alias("listPriceAtPending"),
        text(F.when(F.col("l_quantity") > 25, F.col("l_extendedprice")).otherwise(zero)).alias("closePrice"),
        F.when(F.col("l_linenumber") == 1, "").otherwise(text(F.col("l_linenumber") - 4)).alias("mlsDOM"),
        text(2000 + F.col("l_linenumber") * 5).alias("yearBuilt"),
        F.when(F.col("l_suppkey") % 3 == 0, "Townhouse row").otherwise("plain").alias("mlsStyleCode"),
    )
    c = f.canonical_fields(e)
    return c.select(
        *key,
        day_text("listDate").alias("list_date"),
        F.coalesce(cents("pendingListPrice"), F.lit(0)).alias("pending_cents"),
        F.coalesce(cents("closePrice"), F.lit(0)).alias("close_cents"),
        F.coalesce("saleToList", zero).alias("sale_to_list"),
        F.col("isLikelyPresoldNewBuild").cast("int").alias("presold"),
        F.col("presoldRuleReason").alias("reason"),
    )


AS_OF = dt.date(2001, 8, 1)
TIERS = [["n_name", "c_mktsegment"], ["r_name", "c_mktsegment"], ["c_mktsegment"]]
MODEL = b.BidModel()
PLACED_SQL = """
    SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day, o_totalprice, n_name, r_name, c_mktsegment,
           o_totalprice / (200000.0 + o_custkey * 100) AS ratio
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""


def _tier_sql(i: int) -> str:
    keys = ", ".join(TIERS[i])
    shares = {"low": MODEL.low_share, "mid": MODEL.strategies[MODEL.strategy], "high": MODEL.high_share}
    spread = ", ".join(f"quantile_cont(ratio, {q}) AS {n}{i}" for n, q in shares.items())
    return f"t{i} AS (SELECT {keys}, count(*) AS n{i}, {spread} FROM comps GROUP BY {keys} HAVING count(*) >= {MODEL.min_comps})"


def _recommend_sql(status: str, select: str) -> str:
    first = lambda n: f"coalesce({', '.join(n + str(i) for i in range(3))})"
    return f"""
    WITH placed AS ({PLACED_SQL}),
    comps AS (SELECT * FROM placed WHERE o_orderstatus = 'F' AND o_custkey % 10 <> 0 AND day BETWEEN DATE '{AS_OF}' - {MODEL.window_days} AND DATE '{AS_OF}'),
    {", ".join(_tier_sql(i) for i in range(3))},
    best AS (
        SELECT o_orderkey, o_totalprice AS ask, n_name, r_name, c_mktsegment, {first("n")} AS n,
               CASE WHEN n0 IS NOT NULL THEN low0 WHEN n1 IS NOT NULL THEN low1 ELSE low2 END AS low,
               CASE WHEN n0 IS NOT NULL THEN mid0 WHEN n1 IS NOT NULL THEN mid1 ELSE mid2 END AS mid,
               CASE WHEN n0 IS NOT NULL THEN high0 WHEN n1 IS NOT NULL THEN high1 ELSE high2 END AS high,
               CASE WHEN n0 IS NOT NULL THEN '{b.TIER_NAMES[0]}' WHEN n1 IS NOT NULL THEN '{b.TIER_NAMES[1]}' WHEN n2 IS NOT NULL THEN '{b.TIER_NAMES[2]}' ELSE '{b.NO_TIER}' END AS tier
        FROM placed LEFT JOIN t0 USING (n_name, c_mktsegment) LEFT JOIN t1 USING (r_name, c_mktsegment) LEFT JOIN t2 USING (c_mktsegment)
        WHERE o_orderstatus = '{status}'),
    scored AS (
        SELECT *, CAST(floor(100 * (0.5 * least(n / {float(MODEL.full_count)}, 1.0) + 0.5 * greatest(1 - (high - low) / {MODEL.widest_spread}, 0.0)) + 0.5) AS BIGINT) AS confidence
        FROM best)
    {select}"""


def _rounded(expression: str) -> str:
    return f"coalesce(CAST(floor(({expression}) + 0.5) AS BIGINT), 0)"


BID_SELECT = f"""
    SELECT o_orderkey, '{MODEL.strategy}' AS "bidStrategy", {_rounded("ask * mid")} AS "bidSuggested", {_rounded("ask * low")} AS "bidLow", {_rounded("ask * high")} AS "bidHigh",
           coalesce(round(mid, 6), 0.0) AS "bidRatio", coalesce(confidence, 0) AS "bidConfidence",
           CASE WHEN n IS NULL THEN 'N/A' WHEN confidence >= {MODEL.high_confidence} THEN 'High' WHEN confidence >= {MODEL.medium_confidence} THEN 'Medium' ELSE 'Low' END AS "bidConfidenceLabel",
           coalesce(n, 0) AS "bidCompCount", tier AS "bidCompTier", CASE WHEN n IS NULL THEN '{b.TOO_FEW}' ELSE '{b.SCORED}' END AS "bidStatus"
    FROM scored"""


def _placed(spark, sf) -> DataFrame:
    places = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    joined = table(spark, sf, "orders").join(places, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        day("o_orderdate").alias("day"),
        "o_totalprice",
        "n_name",
        "r_name",
        "c_mktsegment",
        (F.col("o_totalprice") / (200000.0 + F.col("o_custkey") * 100)).alias("ratio"),
    )


def _comps(placed: DataFrame) -> DataFrame:
    """Finished orders as sold enriched rows, through the package's own pool of comparable sales."""
    done = F.col("o_orderstatus") == "F"
    sales = placed.withColumns({
        "dataMode": F.when(done, ENRICHED).otherwise("PUBLIC_PROXY"), "closePrice": F.col("o_totalprice"), "saleToList": F.col("ratio"),
        "saleDate": F.col("day"), "isLikelyPresoldNewBuild": F.col("o_custkey") % 10 == 0,
    })
    return b.comparable_sales(sales, F.lit(AS_OF), MODEL)


def _scored(spark, sf, status: str) -> DataFrame:
    placed = _placed(spark, sf)
    return b.recommend(placed.filter(F.col("o_orderstatus") == status), _comps(placed), TIERS, "o_totalprice", "ratio", MODEL)


def _zero(name: str):
    return F.coalesce(name, F.lit(0)).alias(name)


@workload(_recommend_sql("O", BID_SELECT))
def bid_recommend(spark, sf):
    s = _scored(spark, sf, "O")
    return s.select(
        "o_orderkey",
        "bidStrategy",
        *[_zero(c) for c in ("bidSuggested", "bidLow", "bidHigh")],
        F.coalesce(F.round("bidRatio", 6), F.lit(0.0)).alias("bidRatio"),
        "bidConfidence",
        "bidConfidenceLabel",
        "bidCompCount",
        "bidCompTier",
        "bidStatus",
    )


TOP_COMPS = 5


@workload(
    _recommend_sql(
        "O",
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"""SELECT s.o_orderkey, tier AS "bidCompTier", r AS comp_rank, c.o_orderkey AS comp_o_orderkey, {sql_day_text("c.day")} AS comp_day
                FROM (SELECT o_orderkey, tier, {", ".join(keys)} FROM scored WHERE tier = '{name}') s
                JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY {", ".join(keys)} ORDER BY day DESC, o_orderkey) AS INTEGER) AS r FROM comps) c USING ({", ".join(keys)})
                WHERE r <= {TOP_COMPS}"""
            for name, keys in zip(b.TIER_NAMES, TIERS)
        )
        + ")",
    )
)
def comp_rows(spark, sf):
    placed = _placed(spark, sf)
    order = [F.col("day").desc(), F.col("o_orderkey")]
    used = b.comps_used(_scored(spark, sf, "O"), _comps(placed), "o_orderkey", TIERS, ["o_orderkey", "day"], order, TOP_COMPS)
    return used.withColumn("comp_day", day_text("comp_day"))


@workload(
    _recommend_sql(
        "P",
        f"""SELECT o_orderkey, {_rounded("ask * mid")} AS "projectedClose", {_rounded("ask * low")} AS "projectedLow", {_rounded("ask * high")} AS "projectedHigh",
            coalesce(n, 0) AS "projectionComps", tier AS "projectionTier" FROM scored""",
    )
)
def pending_projection(spark, sf):
    placed = _placed(spark, sf)
    pending = placed.filter(F.col("o_orderstatus") == "P")
    p = b.project_prices(pending, _comps(placed), TIERS, "o_totalprice", "ratio", MODEL)
    return p.select("o_orderkey", *[_zero(c) for c in ("projectedClose", "projectedLow", "projectedHigh")], "projectionComps", "projectionTier")


@workload(
    _recommend_sql(
        "O",
        f"""SELECT o_orderkey, {_rounded("ask * mid")} AS suggested, coalesce(confidence, 0) AS confidence FROM scored
            ORDER BY {_rounded("ask * mid")} DESC, o_orderkey LIMIT 100""",
    )
)
def top_bids(spark, sf):
    # the limit is the feature: the first page of the bid table, sorted by suggested bid
    s = _scored(spark, sf, "O").select("o_orderkey", F.coalesce("bidSuggested", F.lit(0)).alias("suggested"), F.col("bidConfidence").alias("confidence"))
    return f.sorted_top(s, "suggested", "o_orderkey", descending=True, limit=100)


@workload(
    _recommend_sql(
        "O",
        f"""
        SELECT s_suppkey, {_rounded("s_acctbal * coalesce(mid1, mid2)")} AS suggested,
               CASE WHEN n1 IS NOT NULL THEN '{b.TIER_NAMES[0]}' WHEN n2 IS NOT NULL THEN '{b.TIER_NAMES[1]}' ELSE '{b.NO_TIER}' END AS tier
        FROM (SELECT s_suppkey, s_acctbal, r_name, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'none' END AS c_mktsegment
              FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
        LEFT JOIN t1 USING (r_name, c_mktsegment) LEFT JOIN t2 USING (c_mktsegment)""",
    )
)
def manual_scenarios(spark, sf):
    """A table of scenarios (place, type, ask) through the same tiers."""
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    scenarios = table(spark, sf, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey",
        "s_acctbal",
        "r_name",
        F.when(key % 3 == 0, "BUILDING").when(key % 3 == 1, "MACHINERY").otherwise("none").alias("c_mktsegment"),
    )
    s = b.recommend(scenarios, _comps(_placed(spark, sf)), TIERS[1:], "s_acctbal", "ratio", MODEL)
    return s.select("s_suppkey", F.coalesce("bidSuggested", F.lit(0)).alias("suggested"), F.col("bidCompTier").alias("tier"))


def _band_sql(wait: str) -> str:
    return f"CASE WHEN {wait} IS NULL THEN NULL WHEN {wait} <= 7 THEN 0 WHEN {wait} <= 14 THEN 1 WHEN {wait} <= 30 THEN 2 WHEN {wait} <= 60 THEN 3 ELSE 4 END"


SCENARIO_TIERS = [["n_name", "c_mktsegment"], ["zip", "c_mktsegment"], ["c_mktsegment"]]


def _scenario_tier_sql(i: int) -> str:
    same = " AND ".join(f"s.{k} = c.{k}" for k in SCENARIO_TIERS[i])
    bonus = " + ".join(f"coalesce(greatest(0, 2 - abs(s.{b} - c.{b})), 0)" for b in ("dom_band", "cdom_band"))
    # a sale of weight w stands w times
    return f"""t{i} AS (SELECT s_suppkey, count(DISTINCT o_orderkey) AS n{i}, quantile_cont(ratio, 0.25) AS low{i}, quantile_cont(ratio, 0.5) AS mid{i}, quantile_cont(ratio, 0.75) AS high{i}
        FROM (SELECT s_suppkey, o_orderkey, ratio, unnest(range(1 + {bonus})) FROM scenarios s JOIN comps c ON {same}) GROUP BY s_suppkey HAVING count(DISTINCT o_orderkey) >= 6)"""


@workload(f"""
    WITH placed AS ({PLACED_SQL}),
    comps AS (SELECT *, 'Z' || o_custkey % 12 AS zip, {_band_sql("CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_orderkey % 75 END")} AS dom_band, {_band_sql("o_orderkey % 130")} AS cdom_band
              FROM placed WHERE o_orderstatus = 'F' AND o_custkey % 10 <> 0 AND day BETWEEN DATE '2001-08-01' - 90 AND DATE '2001-08-01'),
    scenarios AS (SELECT s_suppkey, s_acctbal, n_name, 'Z' || s_suppkey % 15 AS zip, CASE s_suppkey % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'AUTOMOBILE' ELSE 'none' END AS c_mktsegment,
                  {_band_sql("CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey * 7 % 90 END")} AS dom_band, {_band_sql("s_suppkey * 11 % 200")} AS cdom_band
                  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    {", ".join(_scenario_tier_sql(i) for i in range(3))}
    SELECT s_suppkey, {_rounded("s_acctbal * coalesce(mid0, mid1, mid2)")} AS suggested, {_rounded("s_acctbal * coalesce(low0, low1, low2)")} AS low, {_rounded("s_acctbal * coalesce(high0, high1, high2)")} AS high,
           coalesce(n0, n1, n2, 0) AS comps, CASE WHEN n0 IS NOT NULL THEN 'T1_NEIGHBORHOOD_TYPE' WHEN n1 IS NOT NULL THEN 'T2_ZIP_TYPE' WHEN n2 IS NOT NULL THEN 'T3_CITY_TYPE' ELSE 'NONE' END AS tier
    FROM scenarios LEFT JOIN t0 USING (s_suppkey) LEFT JOIN t1 USING (s_suppkey) LEFT JOIN t2 USING (s_suppkey)""")
def scenario_bids(spark, sf):
    """Scenarios of ask, neighborhood, type, ZIP, DOM and CDOM; sales that waited about as long weigh more."""
    supplier, order, customer = F.col("s_suppkey"), F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(supplier % 4 == 0, "BUILDING").when(supplier % 4 == 1, "MACHINERY").when(supplier % 4 == 2, "AUTOMOBILE").otherwise("none")
    scenarios = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "s_acctbal", "n_name", F.concat(F.lit("Z"), (supplier % 15).cast("string")).alias("zip"), kind.alias("c_mktsegment"),
        F.when(supplier % 5 != 0, supplier * 7 % 90).alias("dom"), (supplier * 11 % 200).alias("cdom"),
    )
    comps = _comps(_placed(spark, sf)).withColumns({
        "zip": F.concat(F.lit("Z"), (customer % 12).cast("string")), "dom": F.when(customer % 9 != 0, order % 75), "cdom": order % 130,
    })
    s = b.recommend(scenarios, comps, SCENARIO_TIERS, "s_acctbal", "ratio", MODEL, near=["dom", "cdom"])
    names = {"bidSuggested": "suggested", "bidLow": "low", "bidHigh": "high"}
    return s.select("s_suppkey", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in names.items()], F.col("bidCompCount").alias("comps"), F.col("bidCompTier").alias("tier"))


@workload(f"""
    SELECT o_orderkey, {sql_cents("o_totalprice")} AS price_cents FROM orders
    WHERE o_orderstatus = 'O' AND o_totalprice > 0 AND o_orderpriority <> '5-LOW'""")
def eligible_listings(spark, sf):
    """Active enriched listings with an ask and no close price."""
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.when(F.col("o_orderpriority") != "5-LOW", "MLS_ENRICHED").otherwise("PUBLIC_PROXY").alias("dataMode"),
        F.when(F.col("o_orderstatus") == "O", status_text(F.lit("ACTIVE"))).otherwise("Sold").alias("mlsStatus"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("closePrice"),
        F.col("o_totalprice").alias("pendingListPrice"),
    )
    return b.eligible_listings(o).select("o_orderkey", cents("o_totalprice").alias("price_cents"))
