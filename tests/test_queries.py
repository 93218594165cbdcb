"""Every registered query against its DuckDB statement on the smallest driver tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck_connection  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF)


def test_every_query_has_sql():
    from sowline.plans import QUERIES
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    srows = df.collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    rel = duck.execute(sql)
    diff = compare(df.columns, srows, [d[0] for d in rel.description], rel.fetchall())
    assert diff is None, diff


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["site", "machine", "date", "runtime_seconds", "runtime_hours",
                          "n_plots_processed"]
