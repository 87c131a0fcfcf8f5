"""Listing data laid over county rows, and rows built for listings the county does not have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deedlink.functions.address import LISTING_ADDRESS, PARCEL_FALLBACK
from deedlink.functions.dates import day_diff, iso_text, lenient_date
from deedlink.functions.keys import base_parcel, major_of, minor_of
from deedlink.functions.numbers import fixed_text, number_text, parse_integer, parse_number
from deedlink.functions.places import enrichment_neighborhood
from deedlink.functions.presence import blank_to_null, first_text, null_to_blank
from deedlink.functions.text import REGION_DEFAULT, speed_tag, type_from_style
from deedlink.operators.aggregates import first_present

#: Columns added by the enrichment, in output order.
ENRICHMENT_COLUMNS = [
    "mlsListDate", "mlsPendingDate", "mlsListPriceAtPending", "mlsClosePrice", "mlsListingNumber", "mlsStatus",
    "mlsRegion", "mlsSellingDate", "mlsContractualDate", "mlsListingPrice", "mlsSellingPrice", "mlsOriginalPrice",
    "mlsDOM", "mlsCDOM", "mlsStyleCode", "mlsSubdivision", "mlsParkingType", "mlsParkingCoveredTotal",
    "mlsTaxesAnnual", "mlsBuildingCondition", "mlsView", "mlsBankOwned", "mlsThirdPartyApprovalRequired",
    "mlsNewConstructionState", "mlsSquareFootageSource", "mlsDateLagDays", "mlsJoinMethod", "mlsDaysToPending",
    "mlsDaysPendingToSale", "hotMarketTag", "saleToListRatio", "saleToOriginalListRatio", "bidUpAmount", "bidUpPct",
]

#: Fields of a listing that ``overlay`` reads.
OVERLAID_FIELDS = [
    "listingNumber", "status", "region", "listingDate", "pendingDate", "contractualDate", "sellingDate",
    "listingPrice", "sellingPrice", "originalPrice", "domRaw", "cdomRaw", "dom", "cdom",
    "styleCode", "subdivision", "beds", "baths", "sqft", "yearBuilt", "zip", "mlsAddress",
    "parkingType", "parkingCoveredTotal", "taxesAnnual", "buildingCondition", "view", "bankOwned",
    "thirdPartyApprovalRequired", "newConstructionState", "squareFootageSource",
]

#: Data modes and join methods.
ENRICHED, PUBLIC = "MLS_ENRICHED", "PUBLIC_PROXY"
BY_SALE, BY_LISTING = "APN_PRICE_DATE_WINDOW", "APN_LISTING_STUB"
SOLD_ONLY, OPEN_ONLY = "MLS_SOLD_NOT_IN_COUNTY", "MLS_STATUS_OPEN"

#: Columns of the parcel snapshot.
SNAPSHOT_COLUMNS = [
    "address", "neighborhood", "type", "typeCode", "addressSource", "zip", "districtName", "area", "subArea",
    "sqFtLot", "zoning", "lat", "lon", "beds", "baths", "sqft", "yearBuilt", "assessedValue",
]

#: Type code of a built row without one, and its neighborhood when nothing else is known.
DEFAULT_TYPE_CODE = "11"
DEFAULT_NEIGHBORHOOD = f"{REGION_DEFAULT} (Other)"


def positive(c: Column) -> Column:
    """The value when above zero, else null."""
    return F.when(c > 0, c)


def positive_text(c: Column) -> Column:
    return F.when(c > 0, number_text(c))


def outcome(list_price: Column, close: Column, original: Column) -> dict[str, Column]:
    """Bid-up and price ratios, 0 where a price they need is missing."""
    both = F.coalesce((close > 0) & (list_price > 0), F.lit(False))
    with_original = F.coalesce((close > 0) & (original > 0), F.lit(False))
    return {
        "bid_up": F.when(both, close - list_price).otherwise(F.lit(0)),
        "bid_up_share": F.when(both, (close - list_price) / list_price).otherwise(F.lit(0.0)),
        "sale_to_list": F.when(both, close / list_price).otherwise(F.lit(0.0)),
        "sale_to_original": F.when(with_original, close / original).otherwise(F.lit(0.0)),
    }


#: Columns ``with_measures`` adds and ``listing_fields`` reads.
MEASURES = ["__list", "__close", "__wait", "__to_sale", "bid_up", "bid_up_share", "sale_to_list", "sale_to_original"]


def with_measures(
    df: DataFrame, list_price: Column, close: Column, original: Column, to_pending: Column, to_sale: Column
) -> DataFrame:
    """Prices, waits and outcome as columns of their own, in two steps, so that each is computed once per row."""
    df = df.withColumns({"__list": list_price, "__close": close, "__wait": to_pending, "__to_sale": to_sale})
    return df.withColumns(outcome(F.col("__list"), F.col("__close"), original))


def listing_fields(c: dict[str, Column], method: Column, lag: Column, outcomes: bool = True) -> dict[str, Column]:
    """The enrichment columns of one listing ``c`` as text, null where there is nothing to tell."""
    list_price, close, to_pending, to_sale = (F.col(n) for n in MEASURES[:4])
    o = {n: F.col(n) for n in MEASURES[4:]}
    ratio = lambda value: F.when(value > 0, fixed_text(value, 4))
    nothing = F.lit(None).cast("string")
    return {
        "mlsListDate": iso_text(c["listingDate"]),
        "mlsPendingDate": iso_text(c["pendingDate"]),
        "mlsListPriceAtPending": positive_text(list_price),
        "mlsClosePrice": positive_text(close),
        "mlsListingNumber": blank_to_null(c["listingNumber"]),
        "mlsStatus": blank_to_null(c["status"]),
        "mlsRegion": blank_to_null(c["region"]),
        "mlsSellingDate": iso_text(c["sellingDate"]),
        "mlsContractualDate": iso_text(c["contractualDate"]),
        "mlsListingPrice": positive_text(c["listingPrice"]),
        "mlsSellingPrice": positive_text(close),
        "mlsOriginalPrice": positive_text(c["originalPrice"]),
        "mlsDOM": F.when(null_to_blank(c["domRaw"]) != "", c["dom"].cast("string")),
        "mlsCDOM": F.when(null_to_blank(c["cdomRaw"]) != "", c["cdom"].cast("string")),
        "mlsStyleCode": blank_to_null(c["styleCode"]),
        "mlsSubdivision": blank_to_null(c["subdivision"]),
        "mlsParkingType": blank_to_null(c["parkingType"]),
        "mlsParkingCoveredTotal": blank_to_null(c["parkingCoveredTotal"]),
        "mlsTaxesAnnual": blank_to_null(c["taxesAnnual"]),
        "mlsBuildingCondition": blank_to_null(c["buildingCondition"]),
        "mlsView": blank_to_null(c["view"]),
        "mlsBankOwned": blank_to_null(c["bankOwned"]),
        "mlsThirdPartyApprovalRequired": blank_to_null(c["thirdPartyApprovalRequired"]),
        "mlsNewConstructionState": blank_to_null(c["newConstructionState"]),
        "mlsSquareFootageSource": blank_to_null(c["squareFootageSource"]),
        "mlsDateLagDays": lag.cast("string"),
        "mlsJoinMethod": method,
        "mlsDaysToPending": to_pending.cast("string"),
        "mlsDaysPendingToSale": to_sale.cast("string"),
        "hotMarketTag": blank_to_null(speed_tag(c["dom"], to_pending)),
        "saleToListRatio": ratio(o["sale_to_list"]) if outcomes else nothing,
        "saleToOriginalListRatio": ratio(o["sale_to_original"]) if outcomes else nothing,
        "bidUpAmount": o["bid_up"].cast("long").cast("string") if outcomes else nothing,
        "bidUpPct": F.when(list_price > 0, fixed_text(o["bid_up_share"], 4)) if outcomes else nothing,
    }


def base_with_keys(base: DataFrame) -> DataFrame:
    """County rows with the hidden columns the matching needs: ``parcel``, ``sale_day``, ``close_amount``."""
    return base.withColumns(
        {
            "parcel": base_parcel("parcelNbr", "major", "minor"),
            "sale_day": lenient_date("saleDate"),
            "close_amount": parse_integer("closePrice"),
        }
    )


def anchor_date(*dates: str) -> Column:
    """Date an open listing counts from: the first of the given dates that is known."""
    return F.coalesce(*[F.col(d) for d in dates])


def parcel_snapshot(base: DataFrame, order: str) -> DataFrame:
    """First value that is not blank per parcel and column."""
    rows = base.filter(F.col("parcel").isNotNull())
    return first_present(rows, ["parcel"], SNAPSHOT_COLUMNS, order)


def overlay(base: DataFrame, matched: DataFrame) -> DataFrame:
    """County rows with the data of their listing, if they have one.

    ``matched`` has ``base_id``, ``method``, ``lag`` and the listing as struct ``c``. A listing found by its sale
    replaces county values; one found while still open only fills gaps and never touches sale date and close price.
    """
    names = [f.name for f in matched.schema["c"].dataType.fields]
    joined = base.join(matched, F.col("ord") == F.col("base_id"), "left")
    c = {n: F.col("c")[n] for n in names}
    sold, stub = F.col("method") == BY_SALE, F.col("method") == BY_LISTING
    any_match = F.col("method").isNotNull()
    has_address = null_to_blank(c["mlsAddress"]) != ""
    gap = (
        (null_to_blank("address") == "")
        | (null_to_blank("addressSource") == PARCEL_FALLBACK)
        | null_to_blank("address").rlike("(?i)address unavailable")
    )
    take_address = has_address & (sold | (stub & gap))

    def replace(name: str, value: Column, when: Column) -> Column:
        return F.when(when & value.isNotNull(), value).otherwise(F.col(name))

    def measure(name: str, value: Column) -> Column:
        missing = parse_number(name) == 0
        return F.when((value > 0) & (sold | (stub & missing)), number_text(value)).otherwise(F.col(name))

    no_type = null_to_blank("type").isin("", "Unknown")
    out = {
        "dataMode": F.when(any_match, ENRICHED).otherwise(F.col("dataMode")),
        "address": F.when(take_address, c["mlsAddress"]).otherwise(F.col("address")),
        "addressSource": F.when(take_address, LISTING_ADDRESS).otherwise(F.col("addressSource")),
        "listDate": replace("listDate", iso_text(c["listingDate"]), any_match),
        "pendingDate": replace("pendingDate", iso_text(c["pendingDate"]), any_match),
        "saleDate": replace("saleDate", iso_text(c["sellingDate"]), sold),
        "listPriceAtPending": replace("listPriceAtPending", positive_text(c["listingPrice"]), any_match),
        "closePrice": replace("closePrice", positive_text(c["sellingPrice"]), sold),
        "type": F.when(stub & no_type, type_from_style(c["styleCode"])).otherwise(F.col("type")),
        "beds": measure("beds", c["beds"]),
        "baths": measure("baths", c["baths"]),
        "sqft": measure("sqft", c["sqft"]),
        "yearBuilt": measure("yearBuilt", c["yearBuilt"]),
        "zip": F.when(stub & (null_to_blank("zip") == ""), blank_to_null(c["zip"])).otherwise(F.col("zip")),
    }
    close = F.when(sold & (c["sellingPrice"] > 0), c["sellingPrice"]).otherwise(F.col("close_amount"))
    # without a list price of its own the listing is measured against the county's, then the assessed value
    county_list = F.when(sold, F.col("listPriceAtPending")).otherwise(
        first_text("listPriceAtPending", "assessedValue")
    )
    list_price = F.when(c["listingPrice"] > 0, c["listingPrice"]).otherwise(parse_integer(county_list))
    sale_day = F.when(sold, c["sellingDate"]).otherwise(F.col("sale_day"))
    joined = with_measures(
        joined,
        list_price,
        close,
        c["originalPrice"],
        day_diff(c["listingDate"], c["pendingDate"]),
        day_diff(c["pendingDate"], sale_day),
    )
    fields = listing_fields(c, F.col("method"), F.col("lag"))
    blank = F.lit(None).cast("string")
    own = [n for n in base.columns if n not in ENRICHMENT_COLUMNS]
    return joined.select(
        *[out.get(n, F.col(n)).alias(n) for n in own],
        *[F.when(any_match, fields[n]).otherwise(blank).alias(n) for n in ENRICHMENT_COLUMNS],
    )


def listing_only_rows(
    listings: DataFrame, snapshot: DataFrame, coords: DataFrame, position: str, sold: bool
) -> DataFrame:
    """Rows for listings no county sale was found for, completed from what is known about their parcel."""
    s = snapshot.select(F.col("parcel").alias("apn"), F.struct(*SNAPSHOT_COLUMNS).alias("s"))
    k = coords.select(F.col("parcel").alias("apn"), F.struct("lat", "lon").alias("k"))
    joined = listings.join(s, "apn", "left").join(k, "apn", "left")
    c = {n: F.col(n) for n in listings.columns}
    snap = {n: F.col("s")[n] for n in SNAPSHOT_COLUMNS}
    list_price, nothing = positive(c["listingPrice"]), F.lit(None).cast("string")
    close = positive(c["sellingPrice"]) if sold else F.lit(None).cast("long")
    number = F.coalesce(blank_to_null("listingNumber"), F.lit("na"))
    index = c[position].cast("string")
    if sold:
        row_id = F.concat_ws("-", F.lit("mls-only"), number, c["apn"], iso_text(c["sellingDate"]), index)
    else:
        row_id = F.concat_ws("-", F.lit("mls-open"), number, c["apn"], index)
    has_address = null_to_blank("mlsAddress") != ""

    def own_or_snapshot(name: str) -> Column:
        return F.coalesce(positive_text(c[name]), snap[name])

    row = {
        "dataMode": F.lit(ENRICHED),
        "id": row_id,
        "address": first_text("mlsAddress", snap["address"]),
        "neighborhood": first_text(
            snap["neighborhood"], enrichment_neighborhood("zip"), "region", F.lit(DEFAULT_NEIGHBORHOOD)
        ),
        "type": first_text(snap["type"], type_from_style("styleCode")),
        "typeCode": first_text(snap["typeCode"], F.lit(DEFAULT_TYPE_CODE)),
        "addressSource": F.when(has_address, LISTING_ADDRESS).otherwise(
            first_text(snap["addressSource"], F.lit(LISTING_ADDRESS))
        ),
        "major": major_of("apn"),
        "minor": minor_of("apn"),
        "parcelNbr": c["apn"],
        "listDate": iso_text("listingDate"),
        "pendingDate": iso_text("pendingDate"),
        "saleDate": iso_text("sellingDate") if sold else nothing,
        "listPriceAtPending": positive_text(list_price),
        "closePrice": positive_text(close),
        "assessedValue": snap["assessedValue"],
        "beds": own_or_snapshot("beds"),
        "baths": own_or_snapshot("baths"),
        "sqft": own_or_snapshot("sqft"),
        "yearBuilt": own_or_snapshot("yearBuilt"),
        "zip": first_text("zip", snap["zip"]),
        **{n: snap[n] for n in ("districtName", "area", "subArea", "sqFtLot", "zoning")},
        "lat": first_text(snap["lat"], F.col("k.lat")),
        "lon": first_text(snap["lon"], F.col("k.lon")),
    }
    joined = with_measures(
        joined,
        list_price,
        close,
        c["originalPrice"],
        day_diff("listingDate", "pendingDate"),
        day_diff("pendingDate", "sellingDate") if sold else F.lit(None).cast("int"),
    )
    fields = listing_fields(c, F.lit(SOLD_ONLY if sold else OPEN_ONLY), nothing, outcomes=sold)
    return joined.select(*[v.alias(n) for n, v in row.items()], *[fields[n].alias(n) for n in ENRICHMENT_COLUMNS])


def unknown_sales(closed: DataFrame, base: DataFrame) -> DataFrame:
    """Closed listings whose (parcel, date, price) the county does not already have."""
    known = (
        base.filter(F.col("parcel").isNotNull() & F.col("sale_day").isNotNull() & (F.col("close_amount") > 0))
        .select(
            F.col("parcel").alias("apn"), F.col("sale_day").alias("sellingDate"), F.col("close_amount").alias("sellingPrice")
        )
        .distinct()
    )
    return closed.join(known, ["apn", "sellingDate", "sellingPrice"], "left_anti")


def union_in_order(parts: list[DataFrame], columns: list[str], rank: str | None = None) -> DataFrame:
    """UNION ALL by name; columns a part lacks are null; ``rank`` numbers the parts for those who need the order."""
    result = None
    for i, part in enumerate(parts):
        part = part if rank is None else part.withColumn(rank, F.lit(i))
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    keep = columns if rank is None else [*columns, rank]
    return result.select(*keep)


def added_columns(base: list[str]) -> list[str]:
    """Base columns in their order, then the enrichment columns the base has not got yet."""
    return [*base, *[c for c in ENRICHMENT_COLUMNS if c not in base]]
