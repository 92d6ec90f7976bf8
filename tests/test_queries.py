from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import check, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_its_sql(spark, con, name):
    same, got, _ = check(spark, con, SF, name)
    assert same is not False and got[1]
