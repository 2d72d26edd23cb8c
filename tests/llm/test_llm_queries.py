"""Queries with DuckDB SQL against it; contract columns of all queries."""

import pytest
from oracle_harness import compare, duck

from codecorpus.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    r = compare(spark, con, name, SF, QUERIES[name], ORACLE[name])
    assert r["match"], r


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
