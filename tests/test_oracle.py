"""Every registered query with SQL equivalent, compared whole on the smallest sample."""

import os

import compare
import pytest

from marketlake.oracle import ORACLE
from marketlake.queries import REGISTRY

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_every_query_has_sql():
    assert set(ORACLE) == set(REGISTRY)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = REGISTRY[name](spark, SF)
    columns, expected = compare.duck_rows(duck, ORACLE[name])
    assert sorted(df.columns) == columns
    assert compare.spark_rows(df) == expected
    assert expected, "an empty result checks nothing"
