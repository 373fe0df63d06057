"""Every registered query beside its SQL twin, at the smallest scale where the bridge gives each line item its own file_id."""

import pytest

import __spark_entry__ as entry
from shelf.plans import load
from tests.compare import compare, connect

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    diff, _ = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert diff is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) > 0
    df.write.format("noop").mode("overwrite").save()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
