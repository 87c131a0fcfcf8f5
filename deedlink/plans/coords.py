"""Coordinate lookup: a GIS export to one point per parcel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deedlink.sources.coordinates import coordinate_lookup
from deedlink.sources.files import path_exists, write_csv


def build_coordinates(spark: SparkSession, source: str, target: str | None = None) -> DataFrame:
    """(major, minor, parcelNbr, lat, lon) sorted by parcel; written as CSV when a target is given."""
    if not path_exists(spark, source):
        raise FileNotFoundError(f"Input not found: {source}")
    table = coordinate_lookup(spark, source)
    if target:
        write_csv(table, target)
    return table
