"""Stratified split and exact quantiles from counts: against brute force, ties, repeated keys and nulls included."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from vantage.operators import features as J
from vantage.operators import stats as ST


def hashed(key):
    return int(hashlib.md5(f"{key}|42".encode()).hexdigest()[:13], 16)


@pytest.mark.parametrize("part_rows", [4, 1024])
def test_split_takes_the_smallest_hashes_of_each_stratum(spark, monkeypatch, part_rows):
    monkeypatch.setattr(J, "PART_ROWS", part_rows)
    monkeypatch.setattr(ST, "avg_rank", lambda *a, **k: pytest.fail("ranks every row"))
    rows = [("a", "x" if k % 3 else "y", f"k{k}") for k in range(200)]
    rows += [("a", "x", "k7")] * 30 + [("b", "x", "same")] * 9 + [("b", "y", "one"), ("c", "x", "k1"), ("c", "x", "k2"), (None, "x", "k3"), ("c", None, "k4")]
    df = spark.createDataFrame(rows, "g string, label string, key string").repartition(4)
    got = J.stratified_split(df, ["g"], "label", "key").collect()
    assert len(got) == len(rows) - 2 and {r.g for r in got} == {"a", "b", "c"}
    strata = defaultdict(list)
    for r in rows:
        strata[r[:2]].append(hashed(r[2]))
    for r in got:
        held, own = strata[r.g, r.label], hashed(r.key)
        rank = sum(h < own for h in held) + (held.count(own) + 1) / 2
        assert r.is_test == (len(held) >= 2 and rank <= math.ceil(len(held) * 0.3)), r


def test_quantiles_cut_only_groups_of_many_values(spark, monkeypatch):
    cut = []
    bounds = ST._chunk_bounds
    monkeypatch.setattr(ST, "_chunk_bounds", lambda df, *a: cut.append(df) or bounds(df, *a))
    r = np.random.default_rng(3)
    few, many = r.integers(0, 4, 3000).astype(float), r.normal(size=900)
    rows = [("few", float(v)) for v in few] + [("many", float(v)) for v in many] + [("few", None), ("many", float("nan")), (None, 1.0), ("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {x.g: x for x in ST.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9], buckets=8, chunk_rows=50).collect()}
    assert got.keys() == {"few", "many", "one"}
    for g, v in (("few", few), ("many", many), ("one", np.array([5.0]))):
        assert got[g].n == len(v) and np.allclose([got[g].q10, got[g].q50, got[g].q90], np.quantile(v, [0.1, 0.5, 0.9]), atol=1e-12)
    assert {x.g for x in cut[0].collect()} == {"many"}
    whole = ST.exact_quantiles(df.where("g = 'many'"), [], "v", [0.5], buckets=8, chunk_rows=50).first()
    assert np.isclose(whole.q50, np.median(many), atol=1e-12)
