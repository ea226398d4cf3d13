"""Corpus queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

from lemniscate.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark):
    compare(spark, name, QUERIES[name], ORACLE_SQL[name], SF)
