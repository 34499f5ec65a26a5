"""Every core query against its SQL; the driver's contract."""

import os

import pytest
from oracle import DATA, connect, same

from fillwise import queries as Q
from fillwise.operators import quantiles as Quantiles

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query_matches_sql(spark, con, name):
    same(Q.QUERIES[name](spark, FOLDER), con, Q.SQL[name])


#: Queries that rank by ranges beyond WINDOW_ROWS rows, as at 1 GB.
RANKED = ["quantile_apply_cont", "quantile_apply_int", "quantile_array", "quantile_build", "quantile_centers", "quantile_empty_cells", "quantile_hist", "quantile_volumes"]


@pytest.mark.parametrize("name", RANKED)
def test_ranks_by_ranges_match_sql(spark, monkeypatch, name):
    # of 10,000 events the bounds of the ranges are a sample's
    monkeypatch.setattr(Quantiles, "WINDOW_ROWS", 0)
    same(Q.QUERIES[name](spark, f"{DATA}/sf0.01"), connect(f"{DATA}/sf0.01"), Q.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 22


def test_nothing_else_imports_the_llm_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(Q.__file__)))
    for folder, _, names in os.walk(f"{root}/fillwise"):
        if "llm" in folder.split(os.sep):
            continue
        for n in names:
            if n.endswith(".py"):
                assert "fillwise.llm" not in open(os.path.join(folder, n)).read()
