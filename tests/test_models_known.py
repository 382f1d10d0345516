"""Fits, rank tests and the classifier chain against answers known beforehand."""

import random
import statistics

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vantage.operators import cluster as CL
from vantage.operators import features as J
from vantage.operators import models as K
from vantage.operators import stats as ST
from vantage.operators.families import CLASSIFIERS, classifier_chain
from vantage.plans.catalog import QUERIES, load_all


def ranks(values):
    """Average ranks by counting: one plus the smaller values plus half of the other equal ones."""
    return [1 + sum(o < v for o in values) + (sum(o == v for o in values) - 1) / 2 for v in values]


@pytest.fixture(scope="module")
def paired(spark):
    r = random.Random(5)
    rows = [(g, float(r.randint(0, 6)), float(r.randint(0, 6)), r.random() < 0.4) for g, n in (("a", 400), ("b", 30), (None, 25)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, a double, b double, f boolean")


def test_wilcoxon_counts_ties_as_rows_do(paired):
    rows, df = paired
    for got in ST.wilcoxon(df, ["g"], "a", "b").collect():
        d = [a - b for g, a, b, _ in rows if g == got.g and a != b]
        rk = ranks([abs(x) for x in d])
        assert got.n == len(d)
        assert got.statistic == min(sum(k for k, x in zip(rk, d) if x > 0), sum(k for k, x in zip(rk, d) if x < 0))


def test_mannwhitney_counts_ties_as_rows_do(paired):
    rows, df = paired
    got = {r.g: r for r in ST.mannwhitney(df, ["g"], "a", "f").collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        x, y = [a for k, a, _, f in rows if k == g and f], [a for k, a, _, f in rows if k == g and not f]
        assert (r.n_true, r.n_false) == (len(x), len(y))
        assert r.u_stat == sum((a > b) + 0.5 * (a == b) for a in x for b in y)


def test_rank_tests_without_groups_and_rows(spark, paired):
    rows, df = paired
    assert ST.wilcoxon(df, [], "a", "b").first().n == sum(a != b for _, a, b, _ in rows)
    assert ST.wilcoxon(df.where("false"), ["g"], "a", "b").count() == 0
    assert ST.mannwhitney(df.where("false"), ["g"], "a", "f").count() == 0


def test_no_window_over_rows(paired):
    """Every window of a rank test reads counted values: below each one stands an aggregate."""
    plan = ST.mannwhitney(paired[1], ["g"], "a", "f")._jdf.queryExecution().optimizedPlan().toString()
    for line in (i for i, x in enumerate(plan.splitlines()) if "Window [" in x):
        assert any("Aggregate" in x for x in plan.splitlines()[line + 1:])


def test_breusch_pagan_without_groups_is_the_single_group(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(1, x, 2 * x + x * r.gauss(0, 1)) for x in (r.random() for _ in range(200))], "g int, x double, y double")
    a, b = ST.breusch_pagan(df, [], "y", ["x"]).first(), ST.breusch_pagan(df, ["g"], "y", ["x"]).first()
    assert (a.n, a.lm_stat, a.p_value) == (b.n, pytest.approx(b.lm_stat), pytest.approx(b.p_value))
    assert a.p_value < 0.01


@pytest.fixture(scope="module")
def two_sides(spark):
    """Label 1 right of the diagonal; the target is a step in x."""
    r = random.Random(7)
    rows = [(i, x, z, int(x > z), 3.0 if x > 0.5 else 1.0) for i, (x, z) in enumerate((r.random(), r.random()) for _ in range(400))]
    return spark.createDataFrame(rows, "id long, x double, z double, y int, t double")


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_tree_regressors_find_the_step(two_sides, kind):
    pred = K.fit_pooled(two_sides.where("id % 4 > 0"), ["x", "z"], "t", kind).transform(two_sides.where("id % 4 = 0"))
    m = K.regression_metrics(pred.withColumn("g", F.lit(1)), ["g"], "t", "prediction").first()
    assert m.n == 100 and m.r2 > 0.9


@pytest.mark.parametrize("kind", ["logreg", "rf", "gbt"])
def test_classifiers_rank_the_sides(two_sides, kind):
    pred = K.fit_pooled(two_sides.where("id % 4 > 0"), ["x", "z"], "y", kind, task="classification").transform(two_sides.where("id % 4 = 0"))
    score = "probability" if "probability" in pred.columns else "rawPrediction"
    out = K.auc(pred.withColumn("g", F.lit(1)).withColumn("s", vector_to_array(score)[1]), ["g"], "y", "s").first()
    assert out.auc > 0.93


def test_classifier_chain_separates_unbalanced_classes(spark):
    r = random.Random(9)
    rows = [(i, g, float(c) * 6 + r.gauss(0, 1) if i % 17 else None, r.gauss(0, 1), c) for g in ("p", "q") for i in range(1000 * (g == "q"), 1000 * (g == "q") + 120) for c in [int(i % 6 == 0)]]
    df = spark.createDataFrame(rows, "id long, g string, u double, v double, y int")
    out = classifier_chain(df, ["g"], "id", "y", ["u", "v"], {}).collect()
    assert sorted((x.g, x.model) for x in out) == sorted((g, m) for g in "pq" for m in CLASSIFIERS)
    assert all(x.auc > 0.8 for x in out)


def test_smote_fills_every_class_exactly(spark):
    rows = [(i, "a", [float(i % 7), float(i % 5)], "big" if i % 5 else "small") for i in range(103)]
    out = J.smote(spark.createDataFrame(rows, "id long, g string, vec array<double>, y string"), ["g"], "id", "vec", "y", k=3)
    n = {r.y: (r.n, r.s) for r in out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("synthetic").cast("int")).alias("s")).collect()}
    big = sum(i % 5 > 0 for i in range(103))
    assert n == {"big": (big, 0), "small": (big, big - (103 - big))}


def test_feature_matrix_values(spark):
    df = spark.createDataFrame([("a", 1.0, "u"), ("a", 3.0, "u"), ("a", None, None), ("a", 9.0, "w")], "g string, x double, c string")
    got = sorted(tuple(r.features) for r in J.feature_matrix(df, ["g"], ["x"], {"c": ["u", "w"]}).collect())
    assert got == [(1.0, 1.0, 0.0), (3.0, 1.0, 0.0), (3.0, 1.0, 0.0), (9.0, 0.0, 1.0)]


def test_feature_matrix_query_tells_what_was_filled(spark, tmp_path):
    r = random.Random(12)
    rows = [(k, 1, k % 5, 4, float(r.randint(1, 50)), r.choice([0.0, 0.1]), 0.04, r.choice("RN"), r.choice("OOF")) for k in range(60)]
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    load_all()
    got = QUERIES["j5_feature_matrix"](spark, str(tmp_path)).first()
    x1 = [(q[4] - 25.5) / 2.45 + 50 * (q[8] == "O") if q[0] % 7 else None for q in rows]
    mid = statistics.median(v for v in x1 if v is not None)
    cat1 = [{"O": "B"}.get(q[8], "A") if q[0] % 5 else None for q in rows]
    held = [c for c in cat1 if c]
    mode = min("AB", key=lambda c: (-held.count(c), c))
    assert (got.n, got.width) == (60, 6)
    assert got.x1_mean == pytest.approx(statistics.fmean(mid if v is None else v for v in x1))
    assert got.cat1_B_mean == pytest.approx(sum((c or mode) == "B" for c in cat1) / 60) and got.cat1_A_mean == pytest.approx(1 - got.cat1_B_mean)
    assert got.cat2_Y_mean == pytest.approx(sum(q[7] == "R" for q in rows) / 60) and got.cat2_X_mean == pytest.approx(1 - got.cat2_Y_mean)
    assert got.x2_mean is not None


def test_pca_finds_the_line(spark):
    rows = [("a", i, [float(i) + 100.0, 2.0 * i, 0.0]) for i in range(50)]
    scores, comp = CL.pca(spark.createDataFrame(rows, "g string, id long, v array<double>"), ["g"], "id", "v", 3, 2)
    assert comp.first().explained[0] == pytest.approx(5 * 212.5)  # sample variance along the line
    s = [r.scores[0] for r in scores.orderBy("id").collect()]
    step = {round(abs(b - a), 9) for a, b in zip(s, s[1:])}
    assert step == {round(5 ** 0.5, 9)}
