"""Every registered query against its oracle SQL."""

import compare
import pytest

import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    columns, rows = compare.spark_rows(catalog.QUERIES[name](spark, SF))
    assert name in catalog.ORACLE
    expected_columns, expected = compare.duck_rows(duck, catalog.ORACLE[name])
    assert columns == expected_columns
    assert rows == expected
