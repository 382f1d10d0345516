"""Plan-shape checks: no cartesian products or row-at-a-time Python in the
SQL-expressible queries, pruned scans, partial aggregation."""

import pytest

from vantage.plans.catalog import ORACLE, QUERIES, load_all


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def registry():
    load_all()
    return QUERIES


def test_flagship_plan(spark, sf_small, registry):
    p = plan_of(registry["m14_segmented_mae"](spark, sf_small))
    assert "CartesianProduct" not in p
    assert "BatchEvalPython" not in p


def test_grouped_ols_plan_prunes_and_pushes(spark, sf_small, registry):
    p = plan_of(registry["k1_grouped_ols"](spark, sf_small))
    assert "ReadSchema: struct<l_orderkey" in p
    assert "l_extendedprice" not in p and "l_shipdate" not in p
    assert "CartesianProduct" not in p


@pytest.mark.parametrize("name", ["v4_regression_pairs", "m12_paired_r2", "m16_drivers_table", "l9_breusch_pagan",
                                  "i12_distance_similarity", "e10_box_stats"])
def test_no_python_no_cartesian(spark, sf_small, registry, name):
    p = plan_of(registry[name](spark, sf_small))
    assert "CartesianProduct" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_prunes_columns(spark, sf_small, registry):
    p = plan_of(registry["e12_dataset_metadata"](spark, sf_small))
    assert "l_extendedprice" not in p  # only l_suppkey / l_partkey are read


def test_every_oracle_has_a_query(registry):
    assert set(ORACLE) <= set(registry)
