"""Plugged-in encoder, array containers, exact Mann-Whitney law, flags of the curve fit, clinical scan."""

import itertools
import random

import numpy as np
import pytest

from vantage.operators import models as K
from vantage.operators import stats as ST
from vantage.operators import text as TX
from vantage.sources import files, npy


# --- encoder

def words():
    return lambda t: [len(w) + ord(w[0]) for w in t.split()]


def vectors():
    table = np.random.default_rng(0).normal(size=(400, 6))

    def encode(ids, length):
        assert ids.shape[1] == 8 and (length > 0).all()
        return table[ids] + np.arange(ids.shape[1])[None, :, None] * 0.01  # a token's vector depends on its place in the window

    return encode


@pytest.mark.parametrize("pooling", ["mean", "first"])
def test_encoder_pools_whole_texts(spark, pooling):
    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "bb", "ccc", "zebra"]) for _ in range(n)) for n in (1, 7, 8, 9, 16, 30, 200)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").repartition(3)
    got = {x.id: x for x in TX.encode_texts(df, "t", "id", words, vectors, pooling, window=8, batch=4).collect()}
    table = np.random.default_rng(0).normal(size=(400, 6))
    for i, t in enumerate(texts):
        ids = words()(t or "")
        assert got[i].n_tokens == len(ids)
        if not ids:
            assert got[i].embedding is None
            continue
        v = np.array([table[x] + (k % 8) * 0.01 for k, x in enumerate(ids)])
        assert np.allclose(got[i].embedding, v.mean(0) if pooling == "mean" else v[0])


# --- array containers

def test_arrays_round_trip(spark, tmp_path):
    r = np.random.default_rng(0)
    held = {"embeddings_m0_data_1_cubic.npy": r.normal(size=(57, 5)), "embeddings_m1_data_1_cubic.npy": np.asfortranarray(r.normal(size=(23, 4)).astype("<f4")),
            "embeddings_m2_data_2_linear.npy": r.normal(size=(11, 3)).astype(">f8"), "embeddings_m3_x.npy": r.integers(0, 9, 6), "embeddings_m4_x.npy": np.asfortranarray(r.normal(size=(9, 2, 3))),
            "embeddings_m5_x.npy": np.zeros((0, 4))}
    for name, x in held.items():
        np.save(tmp_path / name, x)
    (tmp_path / "notes.txt").write_text("no array")
    df = files.scan_embeddings(spark, str(tmp_path), fmt="npy", rows_per_partition=10)
    assert df.rdd.getNumPartitions() == 6 + 3 + 2 + 1 + 1
    got = {}
    for row in df.collect():
        got.setdefault((row.model, row.dataset), {})[row.row_id] = row.embedding
    for name, x in held.items():
        model, dataset = name[:-4].split("_", 2)[1:]
        want = {k: x[k].astype(float).ravel().tolist() for k in range(len(x))}
        assert got.get((model, dataset), {}) == want
    one = spark.read.format("npy").load(f"file:{tmp_path}/embeddings_m0_data_1_cubic.npy")
    assert one.count() == 57 and one.columns == ["file", "row_id", "embedding"]


def test_arrays_that_are_none(tmp_path):
    np.save(tmp_path / "words.npy", np.array(["a", "b"]))
    (tmp_path / "other.npy").write_bytes(b"something else")
    with pytest.raises(ValueError):
        npy.header(str(tmp_path / "words.npy"))
    with pytest.raises(ValueError):
        npy.header(str(tmp_path / "other.npy"))
    with pytest.raises(FileNotFoundError):
        npy.files(str(tmp_path / "missing"))


# --- Mann-Whitney

def enumerated(n1, n2, u):
    n, top, hits = n1 + n2, max(u, n1 * n2 - u), 0
    every = list(itertools.combinations(range(1, n + 1), n1))
    for c in every:
        hits += sum(c) - n1 * (n1 + 1) / 2 >= top
    return min(1.0, 2 * hits / len(every))


def test_u_law_equals_enumeration():
    for n1, n2 in [(1, 1), (1, 7), (3, 4), (8, 2), (5, 5), (8, 8)]:
        for u in range(0, n1 * n2 + 1, max(1, n1 * n2 // 5)):
            assert min(1.0, 2 * ST.u_law_tail(n1, n2, max(u, n1 * n2 - u))) == pytest.approx(enumerated(n1, n2, u), abs=1e-12)
    assert ST.u_law_tail(8, 2000, 0) == pytest.approx(1.0) and ST.u_law_tail(3, 4, 13) == 0


def test_methods_of_mannwhitney(spark):
    r = random.Random(2)
    rows = []
    for g, n1, n2, ties in (("small", 5, 6, False), ("ties", 5, 6, True), ("large", 30, 40, False), ("one", 4, 0, False)):
        for k in range(n1 + n2):
            rows.append((g, float(r.randrange(3)) if ties else r.random() + 0.3 * (k < n1), k < n1))
    df = spark.createDataFrame(rows, "g string, v double, f boolean")
    auto = {x.g: x for x in ST.mannwhitney(df, ["g"], "v", "f", "auto").collect()}
    plain = {x.g: x for x in ST.mannwhitney(df, ["g"], "v", "f").collect()}
    exact = {x.g: x for x in ST.mannwhitney(df, ["g"], "v", "f", "exact").collect()}
    assert {g: x.method for g, x in auto.items()} == {"small": "exact", "ties": "asymptotic", "large": "asymptotic", "one": "asymptotic"}
    assert auto["small"].p_value == pytest.approx(enumerated(5, 6, auto["small"].u_stat)) and auto["one"].p_value is None
    for g in ("ties", "large"):
        assert auto[g].p_value == pytest.approx(plain[g].p_value)
    assert exact["large"].method == "exact" and exact["large"].p_value == pytest.approx(plain["large"].p_value, abs=0.02)
    assert "method" not in ST.mannwhitney(df, ["g"], "v", "f").columns
    with pytest.raises(ValueError):
        ST.mannwhitney(df, ["g"], "v", "f", "other")


# --- curve fit and clinical scan

def test_curve_fit_says_whether_it_converged(spark):
    good = [("good", float(x), 6.0 / (x + 2.0)) for x in range(1, 20)]
    none = [("none", float(x), float(x)) for x in range(1, 20)]  # a straight rise: the best a and b are without bound
    got = {r.g: r for r in K.inverse_fit(spark.createDataFrame(good + none, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert got["good"].converged and got["good"].a == pytest.approx(6, rel=1e-6) and got["good"].b == pytest.approx(2, rel=1e-6)
    assert not got["none"].converged


def test_clinical_scan_reads_missing_marks(spark, tmp_path):
    head = "age,sex,cp,trestbps,chol,fbs,restecg,thalach,exang,oldpeak,slope,ca,thal,num"
    (tmp_path / "c.csv").write_text(f"{head}\n63,1,1,145,233,1,2,150,0,2.3,3,0.0,6.0,0\n67,NA,4,?,286,0,2,108,1,NA,2,?, ,2\n")
    a, b = files.scan_clinical(spark, str(tmp_path / "c.csv")).orderBy("age").collect()
    assert (a.age, a.oldpeak, a.ca, a.thal, a.num) == (63, 2.3, 0, 6, 0)
    assert (b.sex, b.trestbps, b.oldpeak, b.ca, b.thal, b.num) == (None, None, None, None, None, 2)


def test_band_and_weighted_correlation_far_from_zero(spark):
    from vantage.operators import vectors as VX

    r = np.random.default_rng(4)
    x = r.normal(size=150)
    y = 0.5 * x + r.normal(size=150) * 0.1
    near = spark.createDataFrame([(k, float(x[k]), float(y[k]), 1.0 + k % 3) for k in range(150)], "k bigint, x double, y double, w double")
    far = near.selectExpr("k", "x + 1e8 AS x", "y + 1e8 AS y", "w", "'a' AS g")
    a, b = (sorted((t.gi, t.band_low, t.band_high) for t in ST.regression_band(d, [], "x", "y", "k", reps=40, grid=5).collect()) for d in (near, far))
    for (i, lo, hi), (j, lo2, hi2) in zip(a, b):
        assert i == j and lo + 1e8 == pytest.approx(lo2, abs=1e-5) and hi + 1e8 == pytest.approx(hi2, abs=1e-5) and lo <= hi
    got = VX.weighted_pearson(far, ["g"], "x", "y", "w").first().r
    w = 1.0 + np.arange(150) % 3
    c = np.cov(np.stack([x, y]), aweights=w, ddof=0)
    assert got == pytest.approx(c[0, 1] / np.sqrt(c[0, 0] * c[1, 1]), abs=1e-6)
