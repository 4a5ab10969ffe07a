"""Every query against its SQL, on the smallest tables."""

import __spark_entry__ as entry
import check
import pytest
from conftest import SF

from veilframe.queries import release

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert check.compare(QUERIES[name](spark, SF), con, SQL[name]) == []


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows_and_schema(spark):
    df = entry.entry(spark)
    assert df.count() == 150
    assert df.columns == ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def test_model_comparison(spark):
    rows = release._compared(spark, SF).collect()
    assert [r["model"] for r in rows] == ["random_forest", "logistic_regression"]
    for r in rows:
        assert 0 <= r["original_accuracy"] <= 1 and 0 <= r["anonymised_accuracy"] <= 1
        assert r["grade"] in ("Excellent", "Good", "Poor")
