"""Known values and edge cases (FIXTURES.md, small literal fixtures)."""

import math

import pytest
from pyspark.sql import functions as F

from vantage.functions import dist
from vantage.functions import expr as B
from vantage.operators import cluster as CL
from vantage.operators import models as K
from vantage.operators import stats as ST
from vantage.plans import reports as R


def one(df, col):
    return df.select(col).first()[0]


def test_distribution_known_values(spark):
    df = spark.range(1).select(F.lit(10.0).alias("nu"))
    r = df.select(dist.col_t_ppf(0.975, "nu").alias("q"), dist.col_t_sf2("2.228139", "nu").alias("p"),
                  dist.col_chi2_sf("3.841459", 1).alias("c1"), dist.col_chi2_sf("5.991465", 2).alias("c2"),
                  dist.col_chi2_sf("7.814728", 3).alias("c3"), dist.col_norm_sf2("1.959964").alias("z"),
                  dist.col_lgamma("0.5").alias("lg"), dist.col_t_ppf(0.975, "1.0").alias("q1"),
                  dist.col_t_ppf(0.975, "3.0").alias("q3")).first()
    assert r.q == pytest.approx(2.228139, abs=1e-6)
    assert r.p == pytest.approx(0.05, abs=1e-6)
    assert r.c1 == pytest.approx(0.05, abs=1e-6)
    assert r.c2 == pytest.approx(0.05, abs=1e-6)
    assert r.c3 == pytest.approx(0.05, abs=1e-6)
    assert r.z == pytest.approx(0.05, abs=1e-6)
    assert r.lg == pytest.approx(math.lgamma(0.5), abs=1e-12)
    assert r.q1 == pytest.approx(12.706205, abs=1e-5)
    assert r.q3 == pytest.approx(3.182446, abs=1e-6)


def test_na_coercion(spark):
    df = spark.createDataFrame([("0.8",), ("NA",), (None,)], "auc string")
    vals = [r[0] for r in df.select(B.to_numeric("auc")).collect()]
    assert vals == [0.8, None, None]


def test_function_type(spark):
    df = spark.createDataFrame([("data_3_cubic",), ("other",)], "name string")
    assert [r[0] for r in df.select(B.function_type("name")).collect()] == ["cubic", None]


def test_average_rank(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 20.0), (1, 30.0)], "g int, v double")
    ranks = sorted(r["rank"] for r in ST.avg_rank(df, ["g"], "v").collect())
    assert ranks == [1.0, 2.5, 2.5, 4.0]


def test_paired_t(spark):
    df = spark.createDataFrame(list(zip([1, 1, 1, 1], [1.0, 2.0, 3.0, 4.0], [2.0, 2.0, 4.0, 6.0])), "g int, a double, b double")
    r = ST.ttest_paired(df, ["g"], "a", "b").first()
    assert r.mean_diff == pytest.approx(-1.0)
    assert r.t_stat == pytest.approx(-2.449490, abs=1e-6)
    assert r.n == 4
    # two-sided p for t = -2.44949 with 3 df (closed form of the t3 CDF)
    assert r.p_value == pytest.approx(0.091720, abs=2e-6)


def test_elbow_rules(spark):
    df = spark.createDataFrame([(1, k + 1, v) for k, v in enumerate([100.0, 40.0, 35.0, 33.0, 32.0])], "g int, k int, inertia double")
    assert one(CL.elbow_k(df, ["g"], rule="reference"), "elbow_k") == 4
    assert one(CL.elbow_k(df, ["g"], rule="max_curvature"), "elbow_k") == 2
    short = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0)], "g int, k int, inertia double")
    assert one(CL.elbow_k(short, ["g"]), "elbow_k") == 1


def test_auc_with_tie(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 0, 0.4), (1, 1, 0.4), (1, 1, 0.8)], "g int, y int, s double")
    assert one(K.auc(df, ["g"], "y", "s"), "auc") == pytest.approx(0.875)


def test_one_row_group(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    r = ST.summarize_ci(df, ["g"], "v").first()
    assert r.mean == 1.0 and r.std is None and r.sem is None and r.ci is None


def test_constant_column(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0)], "g int, x double, y double")
    r = ST.pearson(df, ["g"], "x", "y").first()
    assert r.r is None and r.p_value is None


def test_row_sentence(spark):
    df = spark.createDataFrame([(0, 1, 63, None)], "fbs int, slope int, age int, thal int")
    assert one(df.select(B.row_sentence(["fbs", "slope", "age", "thal"]).alias("s")), "s") == "no fbs slope 63 age nan thal"


def test_tie_is_not_better(spark):
    df = spark.createDataFrame([(0.5, 0.5)], "a double, b double")
    assert one(df.select(B.better_flag("a", "b", higher_is_better=False).alias("f")), "f") is False


def test_wilcoxon_exact_and_normal(spark):
    # no ties, n = 6: exact law; d = (1, -2, 3, 4, 5, 6) -> W- = 2, p = 2 * 3/64
    a = [2.0, 1.0, 4.0, 5.0, 6.0, 7.0]
    b = [1.0, 3.0, 1.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([(1, x, y) for x, y in zip(a, b)], "g int, a double, b double")
    r = ST.wilcoxon(df, ["g"], "a", "b").first()
    assert r.statistic == pytest.approx(2.0)
    assert r.p_value == pytest.approx(6 / 64)


def test_mannwhitney_u(spark):
    rows = [(1, v, True) for v in [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]] + [(1, v, False) for v in [5.5, 6.5, 10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0]]
    r = ST.mannwhitney(spark.createDataFrame(rows, "g int, v double, f boolean"), ["g"], "v", "f").first()
    assert r.u_stat == pytest.approx(7.0)  # pairs with x > y
    assert 0 < r.p_value < 0.01


def test_breusch_pagan_homoscedastic(spark):
    rows = [(1, float(i), float(i % 7), 2.0 * i + (1 if i % 2 else -1)) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, x1 double, x2 double, y double")
    r = ST.breusch_pagan(df, ["g"], "y", ["x1", "x2"]).first()
    assert r.n == 60 and 0.0 <= r.p_value <= 1.0


def test_grouped_ols_exact(spark):
    rows = [("a", float(x), float(x * x % 5), 1.0 + 2.0 * x - 3.0 * (x * x % 5)) for x in range(20)]
    rows += [("b", float(x), float(x % 3), -4.0 + 0.5 * x + 1.5 * (x % 3)) for x in range(15)]
    df = spark.createDataFrame(rows, "g string, x1 double, x2 double, y double")
    c = {r.g: r for r in K.grouped_ols(df, ["g"], "y", ["x1", "x2"]).collect()}
    assert c["a"].b_intercept == pytest.approx(1.0) and c["a"].b_x1 == pytest.approx(2.0) and c["a"].b_x2 == pytest.approx(-3.0)
    assert c["b"].b_intercept == pytest.approx(-4.0) and c["b"].b_x1 == pytest.approx(0.5) and c["b"].b_x2 == pytest.approx(1.5)


def test_grouped_ols_collinear(spark):
    # x2 = 2 * x1: the collinear column gets 0 and the fit is still exact
    rows = [("a", float(x), 2.0 * x, 3.0 + x) for x in range(10)]
    df = spark.createDataFrame(rows, "g string, x1 double, x2 double, y double")
    r = K.grouped_ols(df, ["g"], "y", ["x1", "x2"]).first()
    assert r.b_x2 == 0.0 and r.b_x1 == pytest.approx(1.0) and r.b_intercept == pytest.approx(3.0)


def test_paired_summary_matches_parts(spark):
    df = spark.createDataFrame([(1, float(i), float(i) * 1.1 + (i % 3)) for i in range(12)], "g int, a double, b double")
    ps = R.paired_summary(df, ["g"], "a", "b").first()
    tt = ST.ttest_paired(df, ["g"], "a", "b").first()
    assert ps.t_stat == pytest.approx(tt.t_stat) and ps.p_value == pytest.approx(tt.p_value)
