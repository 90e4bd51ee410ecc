"""The queries that have SQL against DuckDB."""

import pytest

from tessera.llm.queries import ORACLE, QUERIES

from .oracle import same


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op6_secrets", "op10_decontaminate"])
def test_same_as_sql(spark, name):
    same(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLE[name])
