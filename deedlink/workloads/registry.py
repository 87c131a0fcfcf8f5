"""Registry of queries and the small helpers they share."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deedlink.functions.numbers import round_half_up

Query = Callable[[SparkSession, str], DataFrame]


class Workload(NamedTuple):
    run: Query
    sql: str | None


WORKLOADS: dict[str, Workload] = {}
MODULES = ["scalars", "keyed", "linking", "reporting", "exports", "exploring", "jobs"]


def workload(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under the name of its function."""

    def add(function: Query) -> Query:
        WORKLOADS[function.__name__] = Workload(function, sql)
        return function

    return add


def load_all() -> dict[str, Workload]:
    for name in MODULES:
        importlib.import_module(f"deedlink.workloads.{name}")
    return WORKLOADS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(c: Column | str) -> Column:
    """Money as whole cents, so that sums do not depend on their order."""
    return round_half_up((F.col(c) if isinstance(c, str) else c) * 100)


def sql_cents(expression: str) -> str:
    return f"CAST(floor(({expression}) * 100 + 0.5) AS BIGINT)"


def day(c: str) -> Column:
    return F.col(c).cast("date")


def day_text(c: Column | str) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def sql_day_text(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def sql_case(key: str, values: dict, default: str = "NULL") -> str:
    """A fixed table as a CASE expression."""
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in values.items()) + f" ELSE {default} END"
