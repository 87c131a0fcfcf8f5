"""One application for the whole refresh: county build, enrichment, validation, report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from deedlink.operators.resolve import previous_parcels
from deedlink.operators.validate import REQUIRED_COUNTY_COLUMNS, Validation, require_columns, validate_outputs
from deedlink.plans.county import (
    ACCOUNT_COLUMNS,
    BUILDING_COLUMNS,
    BUILDING_STREET_COLUMNS,
    COUNTY_COLUMNS,
    build_county,
)
from deedlink.plans.enrichment import PART, enrich_sales
from deedlink.sources.coordinates import enrichment_points
from deedlink.sources.files import (
    merge_report,
    path_exists,
    read_optional,
    write_csv,
    write_report,
    write_table,
)
from deedlink.sources.listings import list_exports, read_listings


@dataclass
class RefreshPaths:
    """Where things are. ``previous`` is the enriched table of the last run and never the one being written."""

    account: str
    sale: str
    realtor_dir: str
    county_out: str
    enriched_out: str
    report: str
    parcel: str | None = None
    building: str | None = None
    lookup: str | None = None
    coords: str | None = None
    previous: str | None = None


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if path_exists(spark, path) else None


def refresh_county(spark: SparkSession, paths: RefreshPaths, as_of: dt.date) -> DataFrame:
    """Build the county table and store it as parquet (with row order) and CSV."""
    sources = {n: getattr(paths, n) for n in ("account", "sale", "parcel", "building", "lookup", "coords")}
    table = write_table(build_county(spark, sources, as_of), paths.county_out)
    write_csv(table.orderBy("ord").select(*COUNTY_COLUMNS), paths.county_out + "_csv")
    return table


def refresh_listings(spark: SparkSession, paths: RefreshPaths) -> dict:
    """Build the enriched table from the stored county table and the realtor exports; returns the report."""
    county = _stored(spark, paths.county_out)
    if county is None:
        raise FileNotFoundError(f"Missing base dataset: {paths.county_out}")
    require_columns(county.columns, REQUIRED_COUNTY_COLUMNS, "County dataset")
    files = list_exports(spark, paths.realtor_dir)
    listings = read_listings(spark, paths.realtor_dir)
    before = _stored(spark, paths.previous) if paths.previous and paths.previous != paths.enriched_out else None
    if before is None:
        previous = spark.createDataFrame([], "key string, value string")
    else:
        ordered = before.withColumn("__order", F.struct(PART, "row_position"))
        previous = previous_parcels(ordered, "__order")
    enriched = enrich_sales(
        county,
        listings,
        previous,
        enrichment_points(spark, paths.coords),
        read_optional(spark, paths.building, [*BUILDING_COLUMNS, *BUILDING_STREET_COLUMNS], ordered=False),
        read_optional(spark, paths.account, ACCOUNT_COLUMNS, ordered=False),
    )
    table = write_table(enriched.table, paths.enriched_out)
    write_csv(table.orderBy(PART, "row_position").drop(PART, "row_position"), paths.enriched_out + "_csv")
    report = {
        "generatedAt": dt.datetime.now(dt.timezone.utc).isoformat(),
        "source": {"baseFile": paths.county_out, "realtorDir": paths.realtor_dir, "realtorFiles": files},
        "counts": enriched.counters,
        "apnResolution": enriched.resolution,
        "outputs": {"enrichedTable": paths.enriched_out},
    }
    write_report(spark, report, paths.report)
    return report


def refresh_validation(spark: SparkSession, paths: RefreshPaths, counters: dict[str, int] | None = None) -> Validation:
    """Check the stored outputs and put the result into the report, replacing the last one."""
    files = list_exports(spark, paths.realtor_dir)
    result = validate_outputs(_stored(spark, paths.county_out), _stored(spark, paths.enriched_out), len(files), counters)
    part = {
        "generatedAt": dt.datetime.now(dt.timezone.utc).isoformat(),
        "status": result.status,
        "errors": result.errors,
        "warnings": result.warnings,
        "files": {"public": paths.county_out, "enriched": paths.enriched_out, "realtorCsvCount": len(files)},
        "counts": result.counts,
    }
    merge_report(spark, "validation", part, paths.report)
    return result


def run_refresh(
    spark: SparkSession,
    paths: RefreshPaths,
    as_of: dt.date,
    skip_county: bool = False,
    skip_listings: bool = False,
    report_only: bool = False,
) -> Validation:
    """All stages; a stage that is skipped leaves its stored output as it is. Raises after reporting a failure."""
    counters = None
    if not report_only:
        if not skip_county:
            refresh_county(spark, paths, as_of)
        if not skip_listings:
            report = refresh_listings(spark, paths)
            counters = {**report["counts"], **report["apnResolution"]}
    result = refresh_validation(spark, paths, counters)
    result.raise_if_failed()
    return result


