"""Work that several columns or several reports have in common is done once."""

import numpy as np

from vantage.operators import cluster as CL
from vantage.operators import families as FM
from vantage.operators import features as J
from vantage.operators import stats as ST
from vantage.plans import queries_models as Q


def test_medians_of_all_columns_in_one_pass(spark, monkeypatch):
    r = np.random.default_rng(3)
    a, b = r.normal(size=41).round(1), r.integers(0, 5, 41)
    rows = [("g" if k % 3 else "h", k, None if k % 5 == 0 else float("nan") if k % 7 == 0 else float(a[k]), None if k % 4 == 0 else int(b[k]), None) for k in range(41)]
    rows += [(None, 90, None, 1, None), ("only", 91, None, 2, 3.0)]
    df = spark.createDataFrame(rows, "g string, id int, a double, b int, c double")
    calls, found = [], ST.exact_quantiles
    monkeypatch.setattr(ST, "exact_quantiles", lambda *x, **y: calls.append(x[1]) or found(*x, **y))
    got = {x.id: x for x in J.impute(df, ["g"], ["a", "b", "c"], "median", fit_on=df.id != 40).collect()}
    assert len(calls) == 1 and len(got) == 43
    for g in ("g", "h"):
        mine = [x for x in rows if x[0] == g]
        for at, c in ((2, "a"), (3, "b")):
            median = np.median([x[at] for x in mine if x[1] != 40 and x[at] is not None and x[at] == x[at]])
            for x in mine:
                assert got[x[1]][c] == (median if x[at] is None or x[at] != x[at] else x[at])
    assert all(got[k].c is None for k in range(41)) and got[91].c == 3.0 and got[91].a is None
    assert got[90].a is None and got[90].b == 1  # no group, no median


def test_both_chains_read_the_same_clusters(spark, sf_small, monkeypatch):
    calls, found = [], CL.kmeans
    monkeypatch.setattr(CL, "kmeans", lambda *a: calls.append(a[1]) or found(*a))
    monkeypatch.setattr(FM, "classifier_chain", lambda rows, *a: rows.select("dataset", "cluster_column", "row_id", "cluster"))
    monkeypatch.setattr(Q, "_WRITTEN", {})
    one, two = (sorted(map(tuple, Q.cluster_classification(spark, sf_small, assisted).collect())) for assisted in (True, False))
    assert one == two and len(one) > 0 and len(calls) == 1
