"""Every registered query against its SQL on the smallest tables."""

import check
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert check.compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES.get(name)) is None


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["week", "macro_topic", "mean_score"]
    assert frame.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
