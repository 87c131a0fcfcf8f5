"""Every registered query against its SQL on the smallest tables, and the driver contract."""

import importlib
import os

import pytest
from oracle import compare, connect

from deedlink.workloads import load_all

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")

entry = importlib.import_module("__spark_entry__")
RUN = {name: w.run for name, w in load_all().items()}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in RUN}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(RUN))
def test_query_equals_sql(spark, duck, name):
    if name in SQL:
        # an empty result counts as a difference
        assert compare(spark, duck, FOLDER, RUN[name], SQL[name]) is None
    else:
        assert RUN[name](spark, FOLDER).columns


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "lag", "diff_cents", "score_cents"]
    assert df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(RUN)
