"""Every query against its SQL counterpart; queries without one must run and give rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SLOW = {"fit_and_eval", "cross_validate", "imbalance_table", "smote_borderline", "permutation_importance"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, sf, con, name):
    assert compare(con, entry.oracle_sql()[name], entry.queries()[name](spark, sf)) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_gives_rows(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
