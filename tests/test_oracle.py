"""Every registered query against its SQL counterpart on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from laneflow.plans import catalog, oracles
from tests import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = dict(catalog.REGISTRY), oracles.sql()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare.difference(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


def test_flagship_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "location", "time_window", "section_id", "lane_id", "avg_vel", "avg_acc", "n", "vehicles",
    ]
    assert df.count() > 0
