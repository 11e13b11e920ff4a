"""Every query with SQL against DuckDB, the others for rows and a stable schema."""

import oracle
import pytest

from corpusflow.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    assert oracle.difference(spark, QUERIES[name], SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    first, second = QUERIES[name](spark, sf), QUERIES[name](spark, sf)
    assert first.schema == second.schema
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
