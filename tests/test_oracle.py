"""Every query against its SQL on the sample tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as contract
from nudgetrail.queries import QUERIES
from oracle import ORACLE
from sampled import duck_on, oracle_rows, spark_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    return duck_on(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert contract.queries().keys() >= QUERIES.keys()
    assert contract.oracle_sql().items() >= ORACLE.items()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Plans of the stages that a query writes."""
    plans, parquet = [], DataFrameWriter.parquet

    def recorded(self, *args, **options):
        plans.append(_plan(self._df))
        return parquet(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    return plans


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, written, name):
    df = contract.queries()[name](spark, SF_DIR)
    expected = oracle_rows(duck, name)
    assert expected, "an empty result checks nothing"
    assert spark_rows(df) == expected
    for plan in [*written, _plan(df)]:
        for node in ("NestedLoopJoin", "CartesianProduct", "Python", "Pandas"):
            assert node not in plan


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
