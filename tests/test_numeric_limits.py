"""Results that must hold far from zero, for large counts and for whole inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vantage.functions import dist
from vantage.operators import features as J
from vantage.operators import models as K
from vantage.operators import relational as RL
from vantage.operators import stats as ST


# Published two-sided 5% and 1% points of Student t (and of the normal law, its limit).
POINTS = [(12.706204736, 1, 0.05), (63.656741162, 1, 0.01), (2.228138852, 10, 0.05), (2.042272456, 30, 0.05), (2.750, 30, 0.01), (1.983971519, 100, 0.05)]


def test_t_tail_points(spark):
    df = spark.createDataFrame([(float(t), float(nu), p) for t, nu, p in POINTS], "t double, nu double, p double")
    for r in df.select("p", dist.col_t_sf2("t", "nu").alias("got")).collect():
        assert r.got == pytest.approx(r.p, abs=2e-5)


def test_t_tail_for_any_count(spark):
    rows = [(t, nu) for nu in (1e4, 1e6, 1e7, 1e8, 1e9) for t in (0.5, 1.0, 1.959963984540054, 3.0, 8.0, 31.0, 2000.0, 20000.0)]
    df = spark.createDataFrame(rows, "t double, nu double")
    for r in df.select("t", "nu", dist.col_t_sf2("t", "nu").alias("p"), dist.col_t_ppf(0.975, "nu").alias("q")).collect():
        z = r.t
        phi = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        # normal tail and the first two terms in 1/nu of the t tail
        want = math.erfc(z / math.sqrt(2)) + 2 * phi * ((z ** 3 + z) / (4 * r.nu) + (3 * z ** 7 - 5 * z ** 5 - 7 * z ** 3 - 3 * z) / (96 * r.nu ** 2)) if z < 40 else 0.0
        assert r.p == pytest.approx(want, abs=1e-9)
        assert r.q == pytest.approx(1.959963984540054 + 2.3722 / r.nu, abs=1e-7)


def test_ols_far_from_zero(spark):
    rows = [("a", 1e6 + i, 2 * (1e6 + i) + 1) for i in range(11)] + [("b", 1e6 + i, 5.0) for i in range(11)] + [("c", 3.0, float(i)) for i in range(5)]
    got = {r.g: r for r in K.grouped_ols(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "y", ["x"]).collect()}
    assert (got["a"].b_x, got["a"].b_intercept) == (pytest.approx(2.0, abs=1e-9), pytest.approx(1.0, abs=1e-3))
    assert (got["b"].b_x, got["b"].b_intercept) == (pytest.approx(0.0, abs=1e-9), pytest.approx(5.0, abs=1e-6))
    assert (got["c"].b_x, got["c"].b_intercept) == (0.0, pytest.approx(2.0))


def test_masked_moments_equal_the_smaller_fit(spark):
    r = random.Random(1)
    rows = [(g, r.random(), r.random(), r.random(), r.random()) for g in "ab" for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, x double, z double, w double, y double")
    mom = K.mask_moments(K.cross_moments(df, ["g"], "y", ["x", "z", "w"]), [F.col("g") == "a", F.lit(True), F.col("g") == "b"])
    got = {r.g: r for r in K.solve_moments(mom, ["g"], [0, 1, 2, 3], ["x", "z", "w"]).collect()}
    a = K.grouped_ols(df.where("g = 'a'"), ["g"], "y", ["x", "z"]).first()
    b = K.grouped_ols(df.where("g = 'b'"), ["g"], "y", ["z", "w"]).first()
    assert [got["a"].b_x, got["a"].b_z, got["a"].b_w, got["a"].b_intercept] == pytest.approx([a.b_x, a.b_z, 0, a.b_intercept])
    assert [got["b"].b_x, got["b"].b_z, got["b"].b_w, got["b"].b_intercept] == pytest.approx([0, b.b_z, b.b_w, b.b_intercept])


def test_one_vs_rest_is_shift_free(spark):
    r = random.Random(2)
    rows = [(k % 3, r.gauss(k % 3, 1)) for k in range(60)]
    t = [ST.one_vs_rest_ttest(spark.createDataFrame([(g, v + s) for g, v in rows], "g int, v double"), [], "g", "v").orderBy("g").collect() for s in (0.0, 1e8)]
    assert [x.t_stat for x in t[1]] == pytest.approx([x.t_stat for x in t[0]], rel=1e-5)


def test_neighbours_of_every_point(spark):
    r = random.Random(3)
    pts = [(i, [r.random()]) for i in range(300)] + [(300, [1e7])]
    got = J.knn_within(spark.createDataFrame([("g", *p) for p in pts], "g string, id int, v array<double>"), ["g"], "id", "v", 3, 1)
    by = {}
    for x in got.collect():
        by.setdefault(x.id, set()).add(x.nbr)
    assert len(by) == 301
    for i, (p,) in pts:
        want = sorted(((abs(p - q), j) for j, (q,) in pts if j != i))[:3]
        assert by[i] == {j for _, j in want}


def test_metadata_dedupe_keeps_whole_rows(spark):
    meta = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z")], "dataset string, n int, c string")
    pairs = spark.createDataFrame([("a",), ("b",)], "dataset string")
    assert sorted(map(tuple, RL.merge_with_metadata(pairs, meta, dedupe=True).collect())) == [("a", 1, "y"), ("b", None, "z")]


def test_whole_tables(spark, sf_small):
    from vantage.plans.catalog import QUERIES, load_all

    load_all()
    n = spark.read.parquet(f"{sf_small}/documents.parquet").count()
    assert QUERIES["i1_embed_texts"](spark, sf_small).agg(F.sum("n")).first()[0] == n
    i3 = QUERIES["i3_kmeans"](spark, sf_small)
    assert "converged" in i3.columns and i3.where("not converged").count() == 0


@pytest.mark.parametrize("by", [["g"], []])
def test_ranks_and_quantiles_for_any_chunk_size(spark, by):
    import numpy as np
    import pandas as pd

    r = random.Random(5)
    vals = [float(r.choice([r.gauss(0, 1), r.randrange(5), 10.0 ** r.randrange(9)])) for _ in range(400)]
    rows = [("a", v) for v in vals] + ([("b", v) for v in [math.inf, -math.inf, 1.7e308, -1.7e308, 0.0, 0.0, 3.0]] + [("c", 7.0)] * 5 if by else []) + [("a", None)] * 3
    df = spark.createDataFrame(rows, "g string, v double")
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    want = (pdf.groupby("g")["v"] if by else pdf["v"]).rank().fillna(-1)
    for size in (1, 3, 10**6):
        got = ST.avg_rank(df, by, "v", distributed=True, buckets=4, chunk_rows=size).toPandas().fillna({"rank": -1})
        assert sorted(got["rank"]) == sorted(want)
        one = ST.distinct_value_ranks(df.where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("t")), by, "v", "t", "rk", buckets=4, chunk_rows=size)
        assert one.agg(F.sum(F.col("t") * F.col("rk"))).first()[0] == pytest.approx(want[want > 0].sum())
        q = ST.exact_quantiles(df.where("g = 'a'"), by, "v", [0.1, 0.5, 0.77], buckets=4, chunk_rows=size).first()
        assert [q.q10, q.q50, q.q77] == pytest.approx(np.percentile(vals, [10, 50, 77]).tolist()) and q.n == 400
    spread = ST.avg_rank(df.where("g = 'a'"), by, "v", distributed=True, buckets=4, chunk_rows=3)
    assert spread.count() == 403


def test_breusch_pagan_equals_two_fits(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x = r.normal(1e5, 2.0, (200, 2))
    y = x @ [1.0, -2.0] + r.normal(0, 1, 200) * (1 + np.abs(x[:, 0] - 1e5))
    df = spark.createDataFrame([("g", float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "g string, x1 double, x2 double, y double")
    z = np.hstack([np.ones((200, 1)), x - 1e5])
    u = (y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2
    e = u - z @ np.linalg.lstsq(z, u, rcond=None)[0]
    lm = 200 * (1 - (e ** 2).sum() / ((u - u.mean()) ** 2).sum())
    assert ST.breusch_pagan(df, ["g"], "y", ["x1", "x2"]).first().lm_stat == pytest.approx(lm, rel=1e-6)
