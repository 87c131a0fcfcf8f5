"""County build: five extracts joined by parcel key, cut to one year of sales, 28 text columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deedlink.functions.address import (
    CITY_ZIP_PREFIX,
    PARCEL_FALLBACK,
    mailing_address,
    situs_address,
    trusted_address,
    with_chosen_address,
)
from deedlink.functions.dates import in_rolling_year, iso_text, us_date
from deedlink.functions.numbers import fixed_text, number_text, parse_number, round_half_up
from deedlink.functions.places import county_neighborhood
from deedlink.functions.presence import blank_to_null, first_text, null_to_blank
from deedlink.functions.text import looks_numeric, unquoted, zip5
from deedlink.operators.aggregates import last_value, learned_label, ordered_fold
from deedlink.operators.enrich import PUBLIC
from deedlink.sources.coordinates import county_points
from deedlink.sources.files import FRAGMENT, ORDER, read_optional, read_required

#: Columns read from each extract.
PARCEL_COLUMNS = ["Major", "Minor", "DistrictName", "Area", "SubArea", "SqFtLot", "CurrentZoning"]
ACCOUNT_COLUMNS = ["Major", "Minor", "AddrLine", "CityState", "ZipCode", "ApprLandVal", "ApprImpsVal"]
SALE_COLUMNS = ["Major", "Minor", "SalePrice", "DocumentDate", "ExciseTaxNbr", "PropertyType"]
BUILDING_COLUMNS = [
    "Major", "Minor", "Bedrooms", "BathFullCount", "Bath3qtrCount", "BathHalfCount", "SqFtTotLiving", "YrBuilt",
    "Address", "ZipCode",
]
BUILDING_STREET_COLUMNS = [
    "BuildingNumber", "Fraction", "DirectionPrefix", "StreetName", "StreetType", "DirectionSuffix",
]
LOOKUP_COLUMNS = ["LUType", "LUItem", "LUDescription"]

#: Output columns in order.
COUNTY_COLUMNS = [
    "dataMode", "id", "address", "neighborhood", "type", "typeCode", "addressSource", "major", "minor", "parcelNbr",
    "listDate", "pendingDate", "saleDate", "listPriceAtPending", "closePrice", "assessedValue",
    "beds", "baths", "sqft", "yearBuilt", "zip", "districtName", "area", "subArea", "sqFtLot", "zoning", "lat", "lon",
]

DISTRICT, CITY = "SEATTLE", "Seattle"
OTHER_NEIGHBORHOOD = f"{CITY} (Other)"
TYPE_LOOKUP = "1"
KEY = ["major", "minor"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"major": unquoted("Major"), "minor": unquoted("Minor")})


def district_parcels(parcels: DataFrame, district: str = DISTRICT) -> DataFrame:
    """Parcels of one district, the last row per key."""
    inside = parcels.filter(F.upper(unquoted("DistrictName")) == district).select(
        unquoted("Major").alias("major"),
        unquoted("Minor").alias("minor"),
        unquoted("DistrictName").alias("districtName"),
        unquoted("Area").alias("area"),
        unquoted("SubArea").alias("subArea"),
        parse_number("SqFtLot").alias("sqFtLot"),
        unquoted("CurrentZoning").alias("zoning"),
        ORDER,
    )
    return last_value(inside, KEY, ["districtName", "area", "subArea", "sqFtLot", "zoning"], ORDER)


def building_per_parcel(buildings: DataFrame) -> DataFrame:
    """The building a parcel is described by: fold in file order by living area and by having a site address."""
    line = unquoted("Address")
    typed = buildings.select(
        unquoted("Major").alias("major"),
        unquoted("Minor").alias("minor"),
        parse_number("Bedrooms").alias("bedrooms"),
        (
            parse_number("BathFullCount") + parse_number("Bath3qtrCount") * 0.75 + parse_number("BathHalfCount") * 0.5
        ).alias("baths"),
        parse_number("SqFtTotLiving").alias("sqft"),
        parse_number("YrBuilt").alias("yearBuilt"),
        situs_address(line).alias("siteLine"),
        zip5(F.coalesce(blank_to_null(unquoted("ZipCode")), line)).alias("siteZip"),
        ORDER,
        FRAGMENT,
    )
    folded = ordered_fold(typed, KEY, "sqft", F.col("siteLine") != "", ORDER, FRAGMENT)
    return folded.drop(ORDER, FRAGMENT)


def numeric_code(c: Column) -> Column:
    """A code compared as a number: blank is 0, text that is no number is one common value."""
    text = null_to_blank(c)
    return F.when(text == "", F.lit(0.0)).otherwise(F.coalesce(text.try_cast("double"), F.lit(float("nan"))))


def type_names(lookup: DataFrame) -> DataFrame:
    """(code, typeName) of the property types, the last row per code."""
    rows = lookup.select(
        unquoted("LUType").alias("kind"),
        unquoted("LUItem").alias("item"),
        unquoted("LUDescription").alias("typeName"),
        ORDER,
    ).filter((F.col("kind") == TYPE_LOOKUP) & (F.col("item") != "") & (F.col("typeName") != ""))
    return last_value(rows.withColumn("code", numeric_code(F.col("item"))), ["code"], ["typeName"], ORDER)


def typed_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.select(
        unquoted("Major").alias("major"),
        unquoted("Minor").alias("minor"),
        unquoted("AddrLine").alias("mailLine"),
        F.upper(unquoted("CityState")).alias("mailCity"),
        unquoted("ZipCode").alias("mailZip"),
        (parse_number("ApprLandVal") + parse_number("ApprImpsVal")).alias("assessed"),
        ORDER,
    )


def area_labels(accounts: DataFrame, parcels: DataFrame) -> DataFrame:
    """Neighborhood name learned per (area, subArea) from accounts of known parcels with a mapped postal code.

    Accounts are counted per parcel and name before they meet the parcels.
    """
    named = accounts.withColumn("label", county_neighborhood("mailZip")).filter(F.col("label").isNotNull())
    counted = named.groupBy(*KEY, "label").agg(F.count(F.lit(1)).alias("times"), F.min(ORDER).alias(ORDER))
    placed = counted.join(parcels.select(*KEY, "area", "subArea"), KEY)
    return learned_label(placed, ["area", "subArea"], "label", ORDER, weight="times")


def account_per_parcel(
    accounts: DataFrame, parcels: DataFrame, labels: DataFrame, city: str = DISTRICT
) -> DataFrame:
    """The account with the largest assessed value per key, with its neighborhood.

    Of a known parcel all accounts count, of another one those whose mailing city names the city. Both winners are
    found before the parcels are joined, so many accounts of one parcel are reduced on the map side.
    """
    columns = ["mailLine", "mailCity", "mailZip", "assessed"]
    record, rank = F.struct(*columns), F.struct(-F.col("assessed"), F.col(ORDER))
    winners = (
        accounts.filter(F.col("assessed") > 0)
        .groupBy(*KEY)
        .agg(
            F.min_by(record, rank).alias("any"),
            F.min_by(record, F.when(F.col("mailCity").contains(city), rank)).alias("inside"),
        )
    )
    joined = winners.join(parcels.withColumn("known", F.lit(True)), KEY, "left")
    joined = joined.withColumn("winner", F.when(F.col("known"), F.col("any")).otherwise(F.col("inside")))
    best = joined.filter(F.col("winner").isNotNull()).select(
        *KEY, "winner.*", "districtName", "area", "subArea", "sqFtLot", "zoning"
    )
    best = best.withColumns(
        {
            "area": null_to_blank("area"),
            "subArea": null_to_blank("subArea"),
            "districtName": first_text("districtName", F.lit(CITY)),
            "sqFtLot": F.coalesce("sqFtLot", F.lit(0.0)),
            "zoning": null_to_blank("zoning"),
        }
    )
    named = (F.col("subArea") != "") & ~looks_numeric("subArea")
    neighborhood = F.when(named, F.col("subArea")).otherwise(
        F.coalesce(F.col("label"), county_neighborhood("mailZip"), F.lit(OTHER_NEIGHBORHOOD))
    )
    return best.join(labels, ["area", "subArea"], "left").withColumn("neighborhood", neighborhood).drop("label")


def county_rows(
    sales: DataFrame, accounts: DataFrame, buildings: DataFrame, types: DataFrame, points: DataFrame, as_of: Column
) -> DataFrame:
    """Sales of the rolling year with account, building, type and point; the 28 columns plus the row order."""
    code = unquoted("PropertyType")
    typed = _keyed(sales).select(
        *KEY,
        parse_number("SalePrice").alias("price"),
        us_date(unquoted("DocumentDate")).alias("day"),
        unquoted("ExciseTaxNbr").alias("excise"),
        code.alias("typeCode"),
        numeric_code(code).alias("code"),
        ORDER,
    )
    recent = typed.filter(in_rolling_year("day", as_of))
    place = points.select(
        F.substring("parcel", 1, 6).alias("major"), F.substring("parcel", 7, 4).alias("minor"), "lat", "lon"
    )
    joined = (
        recent.join(accounts, KEY)
        .join(buildings, KEY, "left")
        .join(types, "code", "left")
        .join(place, KEY, "left")
    )
    joined = joined.withColumn("mailText", mailing_address("mailLine", "mailCity", "mailZip"))
    joined = with_chosen_address(joined, "mailLine", "mailCity", "mailZip", "mailText", "siteLine", "siteZip")
    joined = joined.withColumn("postal", first_text("chosen.zip", zip5("mailZip")))
    postal = F.col("postal")
    joined = joined.withColumn(
        "trusted", trusted_address(F.col("chosen.address"), F.col("chosen.source"), postal)
    )
    trusted = F.col("trusted")
    fallback = F.concat(
        F.lit("Parcel "), F.col("major"), F.lit("-"), F.col("minor"),
        F.lit(f" ({CITY} property address unavailable)"),
    )
    whole = lambda c: round_half_up(F.coalesce(F.col(c), F.lit(0.0))).cast("string")
    day = iso_text("day")
    columns = {
        "dataMode": F.lit(PUBLIC),
        "id": first_text("excise", F.concat("major", "minor")),
        "address": F.when(trusted, F.col("chosen.address")).otherwise(fallback),
        "neighborhood": F.col("neighborhood"),
        "type": F.coalesce(
            F.col("typeName"), F.when(F.col("typeCode") != "", F.concat(F.lit("Type "), "typeCode")), F.lit("Unknown")
        ),
        "typeCode": blank_to_null("typeCode"),
        "addressSource": F.when(trusted, F.col("chosen.source")).otherwise(PARCEL_FALLBACK),
        "major": F.col("major"),
        "minor": F.col("minor"),
        "parcelNbr": F.concat("major", "minor"),
        "listDate": day,
        "pendingDate": day,
        "saleDate": day,
        "listPriceAtPending": whole("assessed"),
        "closePrice": whole("price"),
        "assessedValue": whole("assessed"),
        "beds": whole("bedrooms"),
        "baths": fixed_text(F.coalesce(F.col("baths"), F.lit(0.0)), 2),
        "sqft": whole("sqft"),
        "yearBuilt": whole("yearBuilt"),
        "zip": F.when(trusted & zip5(postal).startswith(CITY_ZIP_PREFIX), postal),
        "districtName": F.col("districtName"),
        "area": blank_to_null("area"),
        "subArea": blank_to_null("subArea"),
        "sqFtLot": whole("sqFtLot"),
        "zoning": blank_to_null("zoning"),
        "lat": number_text("lat"),
        "lon": number_text("lon"),
    }
    return joined.select(*[v.alias(k) for k, v in columns.items()], ORDER)


def county_proxy(
    parcels: DataFrame,
    accounts: DataFrame,
    sales: DataFrame,
    buildings: DataFrame,
    lookup: DataFrame,
    points: DataFrame,
    as_of: dt.date,
) -> DataFrame:
    """All extracts as frames (with row order) to the county table; ``ord`` carries the order of the sales."""
    known = district_parcels(parcels)
    typed = typed_accounts(accounts)
    per_parcel = account_per_parcel(typed, known, area_labels(typed, known))
    return county_rows(
        sales, per_parcel, building_per_parcel(buildings), type_names(lookup), points, F.lit(as_of).cast("date")
    )


def build_county(spark: SparkSession, paths: dict[str, str], as_of: dt.date) -> DataFrame:
    """The county table out of files; account and sale extract are required, the rest is optional."""
    return county_proxy(
        read_optional(spark, paths.get("parcel"), PARCEL_COLUMNS),
        read_required(spark, paths["account"], ACCOUNT_COLUMNS),
        read_required(spark, paths["sale"], SALE_COLUMNS),
        read_optional(spark, paths.get("building"), BUILDING_COLUMNS),
        read_optional(spark, paths.get("lookup"), LOOKUP_COLUMNS),
        county_points(spark, paths.get("coords")),
        as_of,
    )
