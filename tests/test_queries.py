from __future__ import annotations

import pytest

import __spark_entry__
from quillsift.catalogue import ORACLES, QUERIES
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql_gives_the_same(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name], SF)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
