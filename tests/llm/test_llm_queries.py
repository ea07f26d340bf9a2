import re

import pytest

import __spark_entry__
from tests.parity import connected, same
from voxelloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    same(QUERIES[name](spark, SF), connected(SF), ORACLES[name])


def test_names():
    assert {int(m[1]) for q in QUERIES if (m := re.match(r"op(\d+)_", q))} == set(range(1, 14)) and "pipeline" in QUERIES
    assert set(QUERIES) <= set(__spark_entry__.queries())
