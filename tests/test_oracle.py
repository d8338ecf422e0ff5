"""Registered queries against their SQL in DuckDB on the shared tables."""

import pytest

from starfold.catalog import all_queries, all_sql
from tests.check import DATA, connect, diff

QUERIES, SQL = all_queries(), all_sql()
# One or two per area; python -m tests.check runs all of them.
SMOKE = [
    "load_lc", "result_header_upsert", "interp_masked", "mask_outliers", "quality_mask", "mean_depth", "box_depth", "ffa",
    "cumsum_top", "search_clipped", "search_bls", "bls_spectrum", "label_transit", "autocorr", "occult_small", "inject",
    "coef_stats", "detection_efficiency",
]


@pytest.fixture(scope="module")
def duck():
    return connect("sf0.001")


@pytest.mark.parametrize("name", SMOKE)
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA / "sf0.001")).toPandas()
    assert diff(got, duck.sql(SQL[name]).df()) is None


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_statements_parse(duck):
    for name, text in SQL.items():
        duck.sql("EXPLAIN " + text).fetchall()
