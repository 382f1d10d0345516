
import pytest
from pyspark.sql import functions as F

from vantage.operators import cluster as CL
from vantage.operators import features as J
from vantage.operators import models as K
from vantage.operators import stats as ST
from vantage.operators import vectors as VX


def test_auc_reversed_scores(spark):
    rows = [(1, i % 2, float((i * 37) % 11)) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, y int, s double")
    a = K.auc(df, ["g"], "y", "s").first().auc
    b = K.auc(df.withColumn("s", -F.col("s")), ["g"], "y", "s").first().auc
    assert a + b == pytest.approx(1.0)


def test_spearman_monotone_invariant(spark):
    rows = [(1, float(i), float((i * 7) % 13)) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    a = ST.spearman(df, ["g"], "x", "y").first().rho
    b = ST.spearman(df.withColumn("x", F.exp(F.col("x") / 10.0)), ["g"], "x", "y").first().rho
    assert a == pytest.approx(b)


def test_kmeans_separated_blobs(spark):
    rows = []
    for c, (cx, cy) in enumerate([(0, 0), (50, 0), (0, 50)]):
        for i in range(20):
            rows.append(("d", c * 100 + i, [cx + (i % 5) * 0.1, cy + (i // 5) * 0.1], c))
    df = spark.createDataFrame(rows, "g string, id int, v array<double>, truth int")
    a, centers, cost = CL.kmeans(df, ["g"], "id", "v", 3, n_init=3)
    j = a.join(df, a.id == df.id).groupBy("truth").agg(F.countDistinct("cluster").alias("k")).collect()
    assert all(r.k == 1 for r in j)
    assert centers.count() == 3
    assert cost.first().inertia < 10.0


def test_pca_centered_and_ordered(spark):
    rows = [("d", i, [float(i), float(i) * 0.5 + (i % 3), float(i % 4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, id int, v array<double>")
    scores, comp = CL.pca(df, ["g"], "id", "v", 3, 2)
    s = scores.select(F.col("scores")[0].alias("p1"), F.col("scores")[1].alias("p2"))
    m = s.agg(F.avg("p1"), F.avg("p2"), F.var_samp("p1"), F.var_samp("p2")).first()
    assert abs(m[0]) < 1e-9 and abs(m[1]) < 1e-9
    assert m[2] >= m[3]
    ex = comp.first().explained
    assert ex[0] == pytest.approx(m[2]) and ex[1] == pytest.approx(m[3])


def test_distance_similarity_self_is_one(spark):
    raw = spark.createDataFrame([("d", i, float(i), float(i * i % 7), float(i % 3)) for i in range(25)],
                                "dataset string, row_id int, x1 double, x2 double, x3 double")
    emb = raw.select("dataset", F.lit("self").alias("model"), "row_id", F.array("x1", "x2", "x3").alias("embedding"))
    r = VX.distance_similarity(raw, emb, ["x1", "x2", "x3"]).first()
    assert r.distance_correlation == pytest.approx(1.0) and r.cosine_similarity == pytest.approx(1.0)


def test_split_fraction(spark):
    df = spark.range(20000).withColumn("key", F.col("id").cast("string"))
    share = J.split(df, "key").agg(F.avg(F.col("is_test").cast("double"))).first()[0]
    assert abs(share - 0.3) < 0.015


def test_partitioning_does_not_change_results(spark):
    rows = [(f"g{i % 5}", float(i), float((i * 13) % 17), float(i) * 0.3 + (i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x1 double, x2 double, y double")
    a = sorted((r.g, round(r.b_x1, 9)) for r in K.grouped_ols(df.repartition(1), ["g"], "y", ["x1", "x2"]).collect())
    b = sorted((r.g, round(r.b_x1, 9)) for r in K.grouped_ols(df.repartition(17), ["g"], "y", ["x1", "x2"]).collect())
    assert a == b


def test_smote_balances_and_interpolates(spark):
    rows = [("g", i, [float(i), float(i % 4)], 1) for i in range(30)] + [("g", 100 + i, [float(i) * 2, 10.0 + i], 0) for i in range(6)]
    df = spark.createDataFrame(rows, "src string, id int, v array<double>, y int")
    out = J.smote(df, ["src"], "id", "v", "y", k=3)
    counts = {r.y: r.n for r in out.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts[0] == counts[1] == 30
    syn = out.where(F.col("synthetic") & (F.col("y") == 0)).select("v").collect()
    for r in syn:  # minority synthetic points stay inside the minority bounding box
        assert 0.0 <= r.v[0] <= 10.0 and 10.0 <= r.v[1] <= 15.0


def test_knn_exact(spark):
    rows = [("g", i, [float(i % 10), float(i // 10)]) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, id int, v array<double>")
    nn = J.knn_within(df, ["g"], "id", "v", 4, 2)
    # interior point 55 = (5, 5): its 4 nearest are at distance 1
    d = sorted(r.d for r in nn.where(F.col("id") == 55).collect())
    assert d == [1.0, 1.0, 1.0, 1.0]
    assert nn.groupBy("id").count().where(F.col("count") != 4).count() == 0


def test_inverse_fit_recovers(spark):
    rows = [(float(x), 120.0 / (x + 3.0)) for x in range(1, 30)]
    df = spark.createDataFrame(rows, "x double, y double")
    p = K.inverse_fit(df, "x", "y", iters=40).first()
    assert p.a == pytest.approx(120.0, rel=1e-4) and p.b == pytest.approx(3.0, rel=1e-4)


def test_silhouette_two_blobs(spark):
    rows = [("d", i, [0.0 + (i % 3) * 0.01, 0.0], 0) for i in range(10)] + [("d", 100 + i, [10.0 + (i % 3) * 0.01, 0.0], 1) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, id int, v array<double>, lab int")
    s = VX.silhouette(df, ["g"], "id", "v", "lab").first().silhouette
    assert s > 0.99


def test_regression_band_contains_line(spark):
    from vantage.operators import stats as STS
    rows = [(i, float(i), 2.0 * i + ((i * 7) % 5) - 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    band = STS.regression_band(df, [], "x", "y", "k", reps=50, grid=10)
    line = STS.regression_line(df, [], "x", "y").first()
    for r in band.collect():
        fit = line.intercept + line.slope * r.gx
        assert r.band_low - 1e-9 <= fit <= r.band_high + 1e-9


def test_silhouette_sq_matches_brute_force(spark):
    import numpy as np
    pts = [(i, [float((i * 7) % 11), float((i * 3) % 5)], i % 3) for i in range(30)]
    df = spark.createDataFrame([("d", i, v, lab) for i, v, lab in pts], "g string, id int, v array<double>, lab int")
    got = VX.silhouette_sq(df, ["g"], "v", "lab").first().silhouette_sq
    X = np.array([p[1] for p in pts])
    L = np.array([p[2] for p in pts])
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(X)):
        own = L == L[i]
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, L == c].mean() for c in set(L) if c != L[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(float(np.mean(s)))


def test_pair_sums_over_whole_datasets(spark):
    import numpy as np
    r = np.random.default_rng(4)
    x, y = r.normal(size=(700, 3)), r.normal(size=(700, 2))
    x[300:], y[300:] = 5 * x[300:], x[300:, :2]  # the rows past the 300th decide
    x[7] = x[8]
    raw = spark.createDataFrame([("d", i, *map(float, v)) for i, v in enumerate(x)] + [("one", 0, 1.0, 2.0, 3.0)], "dataset string, row_id int, x1 double, x2 double, x3 double")
    emb = spark.createDataFrame([("d", "m", i, [float(t) for t in v]) for i, v in enumerate(y)], "dataset string, model string, row_id int, embedding array<double>")
    dx, dy = (np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)) for v in (x, y))
    want = (dx * dy).sum() / np.sqrt((dx * dx).sum() * (dy * dy).sum())
    got = VX.pair_cosine_whole(raw, emb, ["x1", "x2", "x3"]).collect()
    assert len(got) == 1 and got[0].n == 700 and got[0].cosine_similarity == pytest.approx(want)
    first = VX.distance_similarity(raw, emb, ["x1", "x2", "x3"], cap=300).first().cosine_similarity
    assert abs(first - want) > 0.01
    for block in (200, 4096):
        m = {g.dataset: g for g in VX.pair_moments(VX.as_vector(raw, ["x1", "x2", "x3"]), ["dataset"], "row_id", "vec", block=block).collect()}
        assert m["d"].n_pairs == 700 * 699 // 2 and m["d"].sum_a == pytest.approx(dx.sum() / 2) and m["d"].sum_ab == pytest.approx((dx * dx).sum() / 2)
        assert (m["one"].n, m["one"].n_pairs, m["one"].sum_a) == (1, 0, 0.0)


def test_audit_table_chooses_by_whole_datasets(spark, monkeypatch):
    from vantage.plans import queries_ml as Q
    r = __import__("random").Random(5)
    rows = []
    for name in ("head", "tail"):  # "head" agrees in its first 300 rows only, "tail" in all but those
        for i in range(900):
            v = [r.gauss(0, 1) for _ in range(3)]
            same = (i < 300) == (name == "head")
            rows.append((name, i, *v, (v if same else [r.gauss(0, 1) for _ in range(3)]) + [0.0] * 13))
    t = spark.createDataFrame(rows, "dataset string, row_id int, x1 double, x2 double, x3 double, embedding array<double>").cache()
    monkeypatch.setattr(Q.V, "emb_raw", lambda s, d: t.drop("embedding"))
    monkeypatch.setattr(Q.V, "emb_long", lambda s, d: t.select("dataset", F.lit("m").alias("model"), "row_id", "embedding"))
    assert [tuple(g) for g in Q.audit_choice(spark, "").collect()] == [("m", "tail")]
    assert [tuple(g) for g in Q.audit_choice(spark, "", cap=300).collect()] == [("m", "head")]


def test_one_vs_rest_equals_direct_welch(spark):
    rows = [(f"m{i % 3}", float((i * 13) % 17) + (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "m string, v double")
    ovr = {r.m: r for r in ST.one_vs_rest_ttest(df, [], "m", "v").collect()}
    for m in ["m0", "m1", "m2"]:
        flagged = df.withColumn("f", F.col("m") == m).withColumn("one", F.lit(1))
        w = ST.ttest_welch(flagged, ["one"], "v", "f").first()
        assert ovr[m].t_stat == pytest.approx(w.t_stat) and ovr[m].p_value == pytest.approx(w.p_value)
