"""Driver contract: every query runs on the smallest tables; oracles name known queries."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

HEAVY = {"forest_forecast", "boosting_forecast", "model_comparison", "best_forecast", "forecast_summary",
         "best_forecast_check", "stored_forecast_check", "ets_optimum_check"}


def test_oracles_name_registered_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 50


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 5 and "total_revenue" in df.columns


def _own(name):  # the queries of the llm folder have tests of their own
    return name != "pipeline" and not re.match(r"op\d+_", name)


@pytest.mark.parametrize("name", sorted(filter(_own, set(E.queries()) - HEAVY)))
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.limit(5).collect()
    assert len(df.columns) > 0
