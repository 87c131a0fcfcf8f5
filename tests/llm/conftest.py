"""Documents with every awkward case, and the small tables."""

import os

import pytest
from samples import CLASHES, ODD

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward rows with further columns named like those the operators use inside."""
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    rows = [(*r, len(r[1]) if r[1] is not None else None, *["x"] * len(CLASHES)) for r in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def queries():
    import __spark_entry__ as entry

    return entry.queries()
