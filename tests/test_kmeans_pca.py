"""Grouped K-means and PCA against NumPy and known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.operators import cluster as CL
from vantage.operators import kmeans as KM
from vantage.operators import pca as P
from vantage.operators.chunked import write_once


def frame(spark, groups, extra=()):
    rows = [(g, k, v.tolist()) for g, x in groups.items() for k, v in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "g string, id bigint, v array<double>")


def blobs(seed, k, n, d=3, spread=0.5, off=0.0):
    r = np.random.default_rng(seed)
    return off + r.normal(size=(k, d))[r.integers(0, k, n)] * 6 + r.normal(size=(n, d)) * spread


def lloyd(x, centers, tol):
    limit = tol * x.var(0).mean()
    for it in range(300):
        own = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[own == j].mean(0) if (own == j).any() else centers[j] for j in range(len(centers))])
        shift = ((new - centers) ** 2).sum()
        centers = new
        if shift <= limit:
            break
    return centers, ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum()


def test_steps_equal_plain_lloyd():
    x = blobs(1, 4, 300)
    h = np.random.default_rng(0).integers(-2**62, 2**62, 300)
    (got,) = KM.fit_in_memory(x - x.mean(0), h, [4], 1, 300, 1e-4, 42)
    seeds, near = [], None
    for step in range(4):
        _, at = KM.candidate(x - x.mean(0), h, near, 0, step, 42)
        seeds.append(x[at])
        near = ((x[:, None] - np.array(seeds)[None]) ** 2).sum(2).min(1)
    centers, inertia = lloyd(x, np.array(seeds), 1e-4)
    assert got["converged"] and np.isclose(got["inertia"], inertia) and np.allclose(got["centers"] + x.mean(0), centers)


def test_seeds_follow_the_squared_distance():
    """Shares of the second seed over many restarts against D^2 weights."""
    x = np.array([[0.0], [1.0], [3.0]])
    h = np.array([11, 22, 33])
    firsts, picks = np.zeros(3), np.zeros(3)
    for run in range(6000):
        _, a = KM.candidate(x, h, None, run, 0, 5)
        firsts[a] += 1
        if a == 0:
            picks[KM.candidate(x, h, (x[:, 0] - x[0, 0]) ** 2, run, 1, 5)[1]] += 1
    assert np.abs(firsts / 6000 - 1 / 3).max() < 0.03
    assert np.allclose(picks / picks.sum(), [0, 0.1, 0.9], atol=0.03)


def test_seeding_beats_hashed_starts(spark):
    """With one restart each, squared-distance seeds end no worse than plain random ones on every group, and better in sum."""
    r = np.random.default_rng(8)
    groups = {f"g{s}": blobs(s, 6, 240, d=2, spread=0.2) for s in range(6)}
    got = {m.g: m.inertia for m in KM.fit_kmeans(frame(spark, groups), ["g"], "id", "v", [6], n_init=10).collect()}
    for g, x in groups.items():
        plain = min(lloyd(x, x[r.choice(len(x), 6, replace=False)], 1e-4)[1] for _ in range(10))
        assert got[g] <= plain * (1 + 1e-6)


@pytest.mark.parametrize("ks", [[3], [1, 2, 5]])
def test_chunked_steps_equal_one_task(spark, ks):
    groups = {"a": blobs(1, 3, 150, off=1e6), "b": blobs(2, 5, 90), "c": np.ones((7, 3)), "d": blobs(3, 2, 4)}
    df = frame(spark, groups, [("a", 900, None), (None, 901, [0.0] * 3)])
    use = lambda m: {(r.g, r.k): r for r in m.collect()}
    one = use(KM.fit_kmeans(df, ["g"], "id", "v", ks, n_init=3))
    many = use(KM.fit_kmeans(df.repartition(7), ["g"], "id", "v", ks, n_init=3, group_rows=5))
    assert one.keys() == many.keys() == {(g, k) for g in groups for k in ks}
    for key, r in one.items():
        assert np.isclose(r.inertia, many[key].inertia, atol=1e-9) and np.allclose(r.centers, many[key].centers, atol=1e-6)
        assert r.converged and many[key].converged and r.run == many[key].run
    assert all(one["c", k].inertia == 0 for k in ks)


def test_labels_and_costs(spark):
    groups = {"a": blobs(5, 3, 120), "b": blobs(6, 3, 60)}
    df = frame(spark, groups)
    assign, centers, cost = CL.kmeans(df, ["g"], "id", "v", 3)
    cent = {(r.g, r.cluster): np.array(r.center) for r in centers.collect()}
    rows = assign.collect()
    assert len(rows) == 180
    for r in rows:
        d = {c: ((groups[r.g][r.id] - v) ** 2).sum() for (g, c), v in cent.items() if g == r.g}
        assert min(d, key=d.get) == r.cluster and np.isclose(d[r.cluster], r.dist2)
    total = {r.g: r.inertia for r in cost.collect()}
    for g in groups:
        mine = sorted((r for r in rows if r.g == g), key=lambda r: r.id)
        assert np.isclose(total[g], sum(r.dist2 for r in mine))
        seen = list(dict.fromkeys(r.cluster for r in mine))
        assert seen == sorted(seen)  # numbered by their smallest id
    own_k = df.withColumn("k", F.when(F.col("g") == "a", 3).otherwise(2))
    got = {(r.g, r.cluster) for r in CL.kmeans(own_k, ["g", "k"], "id", "v", "k")[0].collect()}
    assert got == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)}


def test_nothing(spark):
    empty = spark.createDataFrame([], "g string, id bigint, v array<double>")
    assert KM.fit_kmeans(empty, ["g"], "id", "v", [2]).count() == 0
    scores, comp = P.pca(empty, ["g"], "id", "v")
    assert scores.count() == comp.count() == 0


# --- elbows and what is built on clusters

def test_elbows_of_blobs(spark):
    r = np.random.default_rng(2)
    centers = np.array([[0.0, 0], [40, 0], [0, 40], [40, 40]])
    x = centers[np.arange(120) % 4] + r.normal(size=(120, 2)) * 0.1
    turn = np.linalg.qr(r.normal(size=(5, 5)))[0][:2]
    got = CL.elbows(frame(spark, {"a": x @ turn, "b": x[:2] @ turn}), ["g"], "id", "v", kmax=7)
    curve = CL.elbow_curve(frame(spark, {"a": x}), ["g"], "id", "v", 7)
    inertia = [c.inertia for c in sorted(curve.collect(), key=lambda c: c.k)]
    assert all(a >= b - 1e-9 for a, b in zip(inertia, inertia[1:])) and inertia[3] < 10 < inertia[2]
    d2 = np.diff(inertia, 2)
    by = {r.g: r for r in got.collect()}
    assert by["a"].k_reference == d2.argmin() + 2 and by["a"].k_max_curvature == d2.argmax() + 2 and by["a"].converged
    assert by["b"].k_reference == 1


def test_cluster_count_summary(spark):
    r = np.random.default_rng(3)
    x = np.array([[0.0, 0], [40, 0], [0, 40], [40, 40]])[np.arange(80) % 4] + r.normal(size=(80, 2)) * 0.1
    rows = [(ds, m, k, (x[k] * s).tolist()) for ds in ("d1", "d2", "d3") for m, s in (("m", 1.0), ("n", 2.0)) for k in range(80)] + [("d4", "m", k, [0.0, 1.0]) for k in range(3)]
    emb = spark.createDataFrame(rows, "dataset string, model string, row_id bigint, embedding array<double>")
    kinds = spark.createDataFrame([("d1", "linear"), ("d2", "linear"), ("d3", "cubic"), ("d4", "cubic")], "dataset string, equation string")
    ks = {(r.dataset, r.model): r.k_reference for r in CL.elbows(emb, ["dataset", "model"], "row_id", "embedding").collect()}
    got = {(r.model, r.equation): r for r in CL.cluster_count_summary(emb, kinds).collect()}
    assert set(got) == {(m, e) for m in "mn" for e in ("linear", "cubic")}
    assert got["m", "linear"].n == 2 and got["m", "linear"].computed_clusters_mean == (ks["d1", "m"] + ks["d2", "m"]) / 2
    assert got["m", "cubic"].n == 1 and got["m", "cubic"].computed_clusters_std is None and got["m", "cubic"].original_clusters_mean == 4


def test_assigned_columns(spark):
    x = np.array([[0.0], [10.0]])[np.arange(20) % 2] + np.arange(20)[:, None] * 0.01
    raw = spark.createDataFrame([("d", k, float(k)) for k in range(22)], "dataset string, row_id bigint, x1 double")
    emb = spark.createDataFrame([("d", m, k, (x[k] * s).tolist()) for m, s in (("m", 1.0), ("n", -1.0)) for k in range(20)],
                                "dataset string, model string, row_id bigint, embedding array<double>")
    got = {r.row_id: (r.cluster_m, r.cluster_n) for r in CL.assign_clusters(raw, emb, ["m", "n"], k=2).collect()}
    assert got == {k: ((k % 2, k % 2) if k < 20 else (None, None)) for k in range(22)}


def test_similarity_of_a_copy_and_a_scaled_one(spark):
    x = blobs(4, 5, 100)
    raw = spark.createDataFrame([("d", k, *map(float, x[k])) for k in range(100)], "dataset string, row_id bigint, x1 double, x2 double, x3 double")
    emb = spark.createDataFrame([("d", m, k, (x[k] * s).tolist()) for m, s in (("same", 1.0), ("twice", 2.0)) for k in range(100)],
                                "dataset string, model string, row_id bigint, embedding array<double>")
    for k in (5, spark.createDataFrame([("d", 4)], "dataset string, k int")):
        got = {r.model: r for r in CL.cluster_similarity(raw, emb, ["x1", "x2", "x3"], k=k).collect()}
        assert all(abs(r.cosine_similarity - 1) < 1e-9 and abs(r.distance_correlation - 1) < 1e-9 for r in got.values()) and set(got) == {"same", "twice"}


def test_audit_rows(spark):
    x = blobs(7, 4, 60, d=3, spread=0.1)
    raw = spark.createDataFrame([(d, k, *map(float, x[k])) for d in ("d", "e") for k in range(61 if d == "x" else 60)], "dataset string, row_id bigint, x1 double, x2 double, x3 double")
    emb = spark.createDataFrame([(d, "m", k, [*map(float, x[k] * 3), 0.0]) for d in ("d", "e") for k in range(50)], "dataset string, model string, row_id bigint, embedding array<double>")
    best = spark.createDataFrame([("m", "d")], "model string, dataset string")
    rows = CL.audit_rows(raw, emb, best, ["x1", "x2", "x3"]).collect()
    assert {r.dataset for r in rows} == {"d"} and len(rows) == 100 and {(r.side, r.row_id) for r in rows} == {(s, k) for s in ("raw", "embedded") for k in range(50)}
    by = {(r.side, r.row_id): r for r in rows}
    c = x[:50] - x[:50].mean(0)
    w, v = np.linalg.eigh(c.T @ c)
    for side, scale in (("raw", 1), ("embedded", 3)):
        got = np.array([[by[side, k].c1, by[side, k].c2] for k in range(50)])
        want = c @ v[:, ::-1][:, :2] * scale
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
        assert {by[side, k].cluster for k in range(50)} == {0, 1, 2, 3}
    assert all(by["raw", k].cluster == by["embedded", k].cluster for k in range(50))


# --- PCA

@pytest.mark.parametrize("off,scale", [(0.0, 1.0), (1e8, 0.3)])
def test_pca_equals_numpy_far_from_zero(spark, monkeypatch, off, scale):
    monkeypatch.setattr(P, "CHUNK_NUMBERS", 100)  # many chunks to merge
    r = np.random.default_rng(1)
    x = {g: off + r.normal(size=(n, 4)) @ r.normal(size=(4, 4)) * scale for g, n in (("a", 300), ("b", 40), ("c", 2), ("d", 1))}
    scores, comp = P.pca(frame(spark, x, [("a", 999, None), (None, 1, [0.0] * 4)]), ["g"], "id", "v")
    got = {c.g: c for c in comp.collect()}
    for g, v in x.items():
        c = v - v.mean(0)
        want = np.sort(np.linalg.eigvalsh(c.T @ c / max(len(v) - 1, 1)))[::-1][:min(len(v), 4)]
        assert np.allclose(got[g].explained, want, rtol=1e-6, atol=1e-7 * scale) and len(got[g].components) == min(len(v), 4)
        assert np.allclose(got[g].mean, v.mean(0), rtol=1e-15, atol=1e-12)
    s = {(r.g, r.id): r.scores for r in scores.collect()}
    assert len(s) == 343
    a = np.array([s["a", k] for k in range(300)])
    assert np.allclose(np.cov(a.T), np.diag(got["a"].explained), atol=1e-6 * scale) and np.abs(a.mean(0)).max() < 1e-6


def test_pca_of_wide_vectors(spark):
    r = np.random.default_rng(2)
    n, d = 400, 768
    x = r.normal(size=(n, 12)) @ r.normal(size=(12, d)) + 0.01 * r.normal(size=(n, d)) + 1e5
    scores, comp = P.pca(frame(spark, {"a": x}).repartition(6), ["g"], "id", "v")
    c = comp.first()
    _, sv, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert len(c.components) == 50 and np.allclose(c.explained[:12], (sv ** 2 / (n - 1))[:12], rtol=1e-6)
    got = np.array([row.scores for row in scores.orderBy("id").collect()])
    back = got @ np.array(c.components) + np.array(c.mean)
    assert np.abs(back - x).max() < 0.1  # twelve axes hold all but the noise


def test_merged_moments():
    r = np.random.default_rng(3)
    x = r.normal(size=(90, 5)) + 1e7
    whole = P.moments(x)
    part = P.merged(P.merged(P.moments(x[:10]), P.moments(x[10:11])), P.moments(x[11:]))
    assert part[0] == 90 and np.allclose(part[1], whole[1], rtol=1e-15) and np.allclose(part[2], whole[2], atol=1e-6)
