"""Canonical fields, filters, key figures and buckets over the enriched table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from deedlink.functions.dates import lenient_date
from deedlink.functions.numbers import parse_number
from deedlink.functions.presence import first_text, null_to_blank, trimmed
from deedlink.operators.aggregates import exact_percentiles
from deedlink.operators.enrich import ENRICHED


def first_positive(*numbers: Column) -> Column:
    """The first number above zero, else null."""
    return F.coalesce(*[F.when(n > 0, n) for n in numbers])


def canonical_fields(df: DataFrame) -> DataFrame:
    """The fields analyses work on, typed; listing values go before county values."""
    kinds = {f.name: f.dataType for f in df.schema}

    def number(name: str) -> Column:
        """A typed column is taken as it is, only text is parsed."""
        if name not in kinds:
            return F.lit(None).cast("double")
        return F.col(name).cast("double") if isinstance(kinds[name], T.NumericType) else parse_number(name)

    def first_date(*names: str) -> Column:
        found = [n for n in names if n in kinds]
        if found and all(isinstance(kinds[n], T.StringType) for n in found):
            return lenient_date(first_text(*found))
        typed = (T.DateType, T.TimestampType, T.TimestampNTZType)
        dates = [F.col(n).cast("date") if isinstance(kinds[n], typed) else lenient_date(n) for n in found]
        return F.coalesce(*dates, F.lit(None).cast("date"))

    c = {n: number(n) for n in (
        "mlsListingPrice", "mlsListPriceAtPending", "pendingListPrice", "listPriceAtPending", "mlsOriginalPrice",
        "originalListPrice", "mlsClosePrice", "closePrice", "saleToListRatio", "saleToOriginalListRatio", "lat", "lon",
    )}
    pending = first_positive(
        c["mlsListingPrice"], c["mlsListPriceAtPending"], c["pendingListPrice"], c["listPriceAtPending"]
    )
    original = first_positive(c["mlsOriginalPrice"], c["originalListPrice"])
    close = first_positive(c["mlsClosePrice"], c["closePrice"])
    # prices become columns of their own first, so that each text is read once
    df = df.withColumns({"__pending": pending, "__original": original, "__close": close})
    pending, original, close = F.col("__pending"), F.col("__original"), F.col("__close")
    typed = df.withColumns(
        {
            "listDate": first_date("mlsListDate", "listDate"),
            "pendingDate": first_date("mlsPendingDate", "pendingDate"),
            "saleDate": first_date("mlsSellingDate", "saleDate"),
            "pendingListPrice": pending,
            "originalListPrice": original,
            "listPriceAtPending": pending,
            "closePrice": close,
            "saleToList": F.coalesce(first_positive(c["saleToListRatio"]), close / pending),
            "saleToOriginalList": F.coalesce(first_positive(c["saleToOriginalListRatio"]), close / original),
            "lat": first_positive(c["lat"]),
            "lon": F.when(c["lon"] != 0, c["lon"]),
        }
    )
    return with_presold_flag(typed.drop("__pending", "__original", "__close"))


#: Signs of a home sold before it was built.
PRESOLD_YEAR = 2023
PRESOLD_STYLE = "(?i)townhouse|new construction|new build"
PRESOLD_TOLERANCE = 1.0


def presold_tests(
    enriched: Column, close: Column, list_price: Column, dom_text: Column, year: Column, style: Column
) -> tuple[Column, Column]:
    """(flag, reason tokens joined by a bar) of a likely pre-sold new build."""
    explicit = trimmed(null_to_blank(dom_text)) != ""
    no_wait = explicit & (parse_number(dom_text) <= 0)
    at_ask = F.coalesce(F.abs(close - list_price) < PRESOLD_TOLERANCE, F.lit(False))
    sold = enriched & F.coalesce((close > 0) & (list_price > 0), F.lit(False))
    new_year = F.coalesce(year >= PRESOLD_YEAR, F.lit(False))
    new_style = null_to_blank(style).rlike(PRESOLD_STYLE)
    flag = sold & no_wait & at_ask & (new_year | new_style)
    tokens = F.concat_ws(
        "|",
        F.when(no_wait, "dom_le_0"),
        F.when(at_ask, "sale_eq_list"),
        F.when(new_year, f"year_built_gte_{PRESOLD_YEAR}"),
        F.when(new_style, "style_new_build"),
    )
    return flag, F.when(flag, tokens).otherwise("")


def with_presold_flag(df: DataFrame) -> DataFrame:
    """Flag and reason on canonical rows."""
    flag, reason = presold_tests(
        F.coalesce(F.col("dataMode") == ENRICHED, F.lit(False)),
        F.col("closePrice"),
        F.col("listPriceAtPending"),
        F.col("mlsDOM"),
        parse_number("yearBuilt"),
        F.col("mlsStyleCode"),
    )
    return df.withColumns({"isLikelyPresoldNewBuild": flag, "presoldRuleReason": reason})


#: Filters an analysis starts with.
DEFAULT_FILTERS = {"type": "Single Family", "closePrice": (1_100_000, 1_400_000)}


def conjunction(filters: dict[str, object]) -> Column:
    """All filters at once: a pair is a closed range (None leaves an end open), a list a choice, else equality."""
    tests = []
    for name, wanted in filters.items():
        c = F.col(name)
        if isinstance(wanted, tuple):
            low, high = wanted
            tests += [c >= low] if low is not None else []
            tests += [c <= high] if high is not None else []
        elif isinstance(wanted, (list, set, frozenset)):
            tests.append(c.isin(*wanted))
        elif wanted is None:
            tests.append(c.isNull())
        else:
            tests.append(c == wanted)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def apply_filters(df: DataFrame, filters: dict[str, object] | None = None) -> DataFrame:
    """Rows that pass all filters; the default ones when none are given."""
    return df.filter(conjunction(DEFAULT_FILTERS if filters is None else filters))


def cross_filter(df: DataFrame, facets: dict[str, tuple[Column, Column]], sums: dict[str, Column] | None = None) -> DataFrame:
    """Rows per facet and value, each facet counted under the filters of all *other* facets.

    ``facets`` gives a facet's value and its filter. A row is marked with the filters it fails (null fails): one that
    fails none counts for every facet and for the facet ``ALL_FACETS``, one that fails a single filter counts for that facet,
    so that its unselected values keep their figures; others count nowhere. One scan, one exchange, and a row is sent on
    only where it counts. ``sums`` are added up beside the rows. Returns ``facet``, ``value`` (text), ``rows`` and the sums.
    """
    fails = [F.when(F.coalesce(passes, F.lit(False)), 0).otherwise(1) for _, passes in facets.values()]
    own = [F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value")) for name, (value, _) in facets.items()]
    whole = F.struct(F.lit(ALL_FACETS).alias("facet"), F.lit(None).cast("string").alias("value"))
    number = reduce(lambda a, b: a + b, fails, F.lit(0))
    place = reduce(lambda a, b: a + b, [f * i for i, f in enumerate(fails, 1)], F.lit(0))
    added = {f"__sum{i}": c for i, c in enumerate((sums or {}).values())}
    marked = df.select(number.alias("__fails"), place.alias("__place"), F.array(*own).alias("__own"), *[c.alias(n) for n, c in added.items()])
    counted_for = F.when(F.col("__fails") == 0, F.concat("__own", F.array(whole))).otherwise(F.slice("__own", F.col("__place"), F.lit(1)))
    entries = marked.filter(F.col("__fails") <= 1).select(F.explode(counted_for).alias("__entry"), *added)
    return entries.groupBy("__entry.facet", "__entry.value").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(n).alias(out) for n, out in zip(added, sums or {})]
    )


#: Facet of the rows that pass every filter: the key figures and the list of records.
ALL_FACETS = "all"


def cross_filtered_rows(df: DataFrame, facets: dict[str, tuple[Column, Column]]) -> DataFrame:
    """The records that pass the filters of all facets."""
    return df.filter(reduce(lambda a, b: a & b, [passes for _, passes in facets.values()], F.lit(True)))


def is_special_sale(bank_owned: Column | str = "mlsBankOwned", approval: Column | str = "mlsThirdPartyApprovalRequired") -> Column:
    """Bank-owned, or a third party has to approve (own choice: any approval text but ``None``)."""
    return (null_to_blank(bank_owned) == "true") | ~null_to_blank(approval).isin("", "None")


def key_figures(df: DataFrame, keys: list[str], price: str, sums: list[str] | None = None) -> DataFrame:
    """Count, exact median and quartiles, least and largest price per group, plus sums of whole-number columns."""
    if not keys:
        one = key_figures(df.withColumn("__all", F.lit(0)), ["__all"], price, sums)
        return one.drop("__all")
    spread = exact_percentiles(df, keys, price, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    plain = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(price).alias("least"),
        F.max(price).alias("largest"),
        *[F.sum(s).cast("long").alias(f"sum_{s}") for s in sums or []],
    )
    return plain.join(spread.drop("n"), keys, "left")


#: Edges of the ratio legend.
RATIO_EDGES = [0.90, 1.00, 1.10, 1.20]


def ratio_bucket(ratio: Column | str) -> Column:
    """Bucket name of a sale-to-list ratio; an edge belongs to the bucket above it."""
    r = F.col(ratio) if isinstance(ratio, str) else ratio
    names = [f"{e:.2f}x" for e in RATIO_EDGES]
    result = F.when(r < RATIO_EDGES[0], f"<{names[0]}")
    for edge, low, high in zip(RATIO_EDGES[1:], names, names[1:]):
        result = result.when(r < edge, f"{low}-{high}")
    return result.when(r >= RATIO_EDGES[-1], f">={names[-1]}").otherwise("unknown")


def ratio_map(df: DataFrame, keys: list[str], ratio: str) -> DataFrame:
    """Rows per place and ratio bucket."""
    return df.groupBy(*keys, ratio_bucket(ratio).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def sorted_top(df: DataFrame, by: str, tiebreak: str, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Rows sorted by one column with a tie-break; with a limit only the top rows meet on one task."""
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    ordered = df.orderBy(first, F.col(tiebreak).asc())
    return ordered if limit is None else ordered.limit(limit)
