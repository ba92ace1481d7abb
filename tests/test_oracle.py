"""Every registered query against its DuckDB oracle on the smallest driver data."""

import pytest

import __spark_entry__ as E
from courtstats.testing import compare, duck_connect

SF = "/root/testdata/sf0.001"
from courtstats.plans.registry import ORACLES, QUERIES, load_all

load_all()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


def test_every_query_has_an_oracle_or_is_listed():
    assert set(QUERIES) - set(ORACLES) <= {"format_columns"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert df.count() >= 0
        return
    ok, msg = compare(df, con, ORACLES[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["PLAYER3_NAME", "count"]
    assert df.count() > 0
