"""Every registered query with an oracle matches DuckDB (sf0.001)."""

import pytest

from vantage.plans.catalog import ORACLE, QUERIES, load_all

load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    from tests.oracle_check import duck_con
    return duck_con(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, con, name):
    from tests.oracle_check import compare
    ok, msg = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert ok, msg
