"""Grouped tree ensembles and their attributions against exact searches and brute force."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.operators import trees as T


def data(n=160, f=4, seed=0):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, f)), 1)
    x[:, -1] = r.integers(0, 2, n)
    y = np.sin(x[:, 0]) * 3 + x[:, 1] * x[:, -1] + r.normal(0, 0.1, n)
    return x, y, r.integers(-2**62, 2**62, n)


def target(y, classes):
    return y if not classes else np.digitize(y, [-1, 1] if classes == 3 else [0]).astype(float)


def one_group(plan, x, y, h):
    per = np.bincount(y.astype(int), minlength=plan.classes).astype(float) if plan.classes else np.zeros(0)
    cuts = [T.thresholds(x[:, f]) for f in range(x.shape[1])]
    found = T.grown(plan, x, y, h, cuts, T.start(plan, len(y), y.sum(), ((y - y.mean()) ** 2).sum(), per))
    return [T.as_arrays(g.model(cuts), plan.outputs) for g in found]


def best_split(x, y, w):
    """Largest drop of the weighted squared error over every feature and threshold (first one on ties)."""
    best = (1e-9, None, None)
    sse = lambda m: float((w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum()) if w[m].sum() else 0.0
    for f in range(x.shape[1]):
        for t in T.thresholds(x[:, f]):
            m = x[:, f] <= t
            if w[m].sum() >= 1 and w[~m].sum() >= 1:
                gain = sse(w > -1) - sse(m) - sse(~m)
                if gain > best[0] + 1e-7:
                    best = (gain, f, t)
    return best


def test_splits_equal_an_exact_search():
    x, y, h = data(90)
    plan = T.Plan("rf", trees=3, depth=4)
    m = one_group(plan, x, y, h)[0]
    checked = 0
    for tree, root in enumerate(m["roots"]):
        todo = [(root, np.ones(len(x), bool))]
        w = T.draws(h, tree, plan.seed)
        while todo:
            node, at = todo.pop()
            f = m["feature"][node]
            assert m["cover"][node] == w[at].sum()
            assert np.allclose(m["value"][node][0] * plan.trees, np.average(y[at], weights=w[at]) - y.mean())
            if f < 0:
                continue
            gain, _, _ = best_split(x[at], y[at], w[at])
            left = at & (x[:, f] <= m["threshold"][node])
            right = at & ~left
            mine = sum(s * float((w[k] * (y[k] - np.average(y[k], weights=w[k])) ** 2).sum()) for s, k in ((1, at), (-1, left), (-1, right)))
            assert np.isclose(mine, gain, rtol=1e-6)
            checked += 1
            todo += [(m["left"][node], left), (m["right"][node], right)]
    assert checked > 20


def test_boosting_equals_residual_rounds():
    """Least-squares boosting rebuilt with exact searches: same predictions after each of a few rounds."""
    x, y, h = data(70)
    plan = T.Plan("gbt", trees=4, depth=2)
    m = one_group(plan, x, y, h)[0]
    pred = np.full(len(y), y.mean())

    def fit(at, level, res):
        if level == 2 or at.sum() < 2:
            return np.where(at, res[at].mean(), 0)
        gain, f, t = best_split(x[at], res[at], np.ones(at.sum()))
        if f is None:
            return np.where(at, res[at].mean(), 0)
        left = at & (x[:, f] <= t)
        return fit(left, level + 1, res) + fit(at & ~left, level + 1, res)

    for _ in range(4):
        pred = pred + 0.1 * fit(np.ones(len(y), bool), 0, y - pred)
    assert np.allclose(T.summed([m], x)[:, 0], pred, atol=1e-9)


@pytest.mark.parametrize("kind,classes", [("rf", 0), ("gbt", 0), ("rf", 3), ("gbt", 3), ("gbt", 2)])
def test_attributions_equal_all_subsets(kind, classes):
    x, y, h = data()
    plan = T.Plan(kind, classes, trees=6, depth=4 if kind == "rf" else 3)
    models = one_group(plan, x, target(y, classes), h)
    m, rows, n = models[0], x[:7], x.shape[1]

    def worth(root, row, known):
        f = m["feature"][root]
        if f < 0:
            return m["value"][root]
        a, b = m["left"][root], m["right"][root]
        if f in known:
            return worth(a if row[f] <= m["threshold"][root] else b, row, known)
        return (m["cover"][a] * worth(a, row, known) + m["cover"][b] * worth(b, row, known)) / m["cover"][root]

    for root in m["roots"][:5]:
        got = T.tree_attribution(m, rows, root)
        for k, row in enumerate(rows):
            for f in range(n):
                rest, want = [g for g in range(n) if g != f], 0.0
                for size in range(n):
                    for s in combinations(rest, size):
                        want = want + factorial(size) * factorial(n - size - 1) / factorial(n) * (worth(root, row, {*s, f}) - worth(root, row, set(s)))
                assert np.allclose(got[k, f], want, atol=1e-12)
    phi = T.attributions(models, x)
    base = T.summed(models, x) - phi.sum(1)
    assert np.allclose(base, base[0], atol=1e-9)  # what is left over is the same for every row


def test_learns_classes():
    x, y, h = data(400)
    for kind in ("rf", "gbt"):
        plan = T.Plan(kind, 3, depth=8 if kind == "rf" else 3)
        models = one_group(plan, x[:300], target(y, 3)[:300], h[:300])
        p = T.probabilities(T.summed(models, x[300:]), plan)
        assert np.allclose(p.sum(1), 1) and (p.argmax(1) == target(y, 3)[300:]).mean() > 0.85


@pytest.mark.parametrize("kind,classes", [("rf", 0), ("gbt", 0), ("rf", 3), ("gbt", 3)])
def test_chunked_growing_equals_growing_in_one_task(spark, kind, classes):
    x, y, _ = data(240)
    y = target(y, classes)
    rows = [(f"g{k % 3}", k, x[k].tolist(), float(y[k])) for k in range(240)]
    rows += [("g9", 900 + k, [1.0, 2.0, 3.0, float(k % 2)], float(k % 2)) for k in range(4)] + [(None, 990, [0.0] * 4, 0.0), ("g0", 991, None, 0.0), ("g1", 992, [0.0] * 4, None)]
    df = spark.createDataFrame(rows, "g string, id bigint, vec array<double>, y double").repartition(5)
    plan = T.Plan(kind, classes, trees=4, depth=3)
    use = lambda m: {(r.g, r.id): r.prediction for r in T.predict(df, m, ["g"], "id", "vec", plan).collect()}
    whole = T.fit_trees(df, ["g"], "id", "vec", "y", plan)
    one, many = use(whole), use(T.fit_trees(df, ["g"], "id", "vec", "y", plan, group_rows=20))
    assert one.keys() == many.keys() and len(one) == 240 + 4 + 1  # every row with group and vector, the missing target's too
    assert all(np.allclose(one[k], many[k], atol=1e-9) for k in one)
    again = use(T.fit_trees(df.repartition(2), ["g"], "id", "vec", "y", plan))
    assert all(np.allclose(one[k], again[k], atol=1e-12) for k in one)


def test_quantile_bins_beyond_the_limit(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=3000)
    df = spark.createDataFrame([("a", float(t), [float(t), float(k % 5)]) for k, t in enumerate(v)], "g string, y double, vec array<double>")
    (row,) = T.grids(df, ["g"], "vec", 32).collect()
    assert len(row.grid) == 2 and len(row.grid[1]) == 5 and 25 <= len(row.grid[0]) <= 33
    share = np.searchsorted(np.sort(v), np.array(row.grid[0])) / 3000
    assert np.abs(np.diff(share) - 1 / 32).max() < 0.02


def test_importance_over_groups(spark):
    x, y, _ = data(300)
    df = spark.createDataFrame([("a" if k % 2 else "b", k, x[k].tolist(), float(y[k] if k % 2 else x[k, 2])) for k in range(300)],
                               "g string, id bigint, vec array<double>, y double")
    plan = T.Plan("gbt", trees=20, depth=3)
    models = T.fit_trees(df, ["g"], "id", "vec", "y", plan)
    names = ["wave", "slope", "third", "flag"]
    got = {(r.g, r.feature): r.importance for r in T.tree_importance(df, models, ["g"], "id", "vec", names, plan, chunk_rows=40).collect()}
    assert len(got) == 8 and max(names, key=lambda f: got["a", f]) == "wave" and max(names, key=lambda f: got["b", f]) == "third"
    held = np.array([k for k in range(300) if k % 2])
    m = [T.as_arrays(r.asDict(), 1) for r in models.where("g = 'a'").collect()]
    assert np.allclose([got["a", f] for f in names], np.abs(T.attributions(m, x[held])[:, :, 0]).mean(0), atol=1e-9)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, id bigint, vec array<double>, y double")
    plan = T.Plan("rf", trees=2)
    models = T.fit_trees(empty, ["g"], "id", "vec", "y", plan)
    assert models.count() == 0 and T.predict(empty, models, ["g"], "id", "vec", plan).count() == 0


@pytest.mark.parametrize("kind,classes", [("rf", 0), ("gbt", 0), ("rf", 3), ("gbt", 3)])
def test_a_batch_of_groups_grows_as_each_alone(kind, classes):
    plan = T.Plan(kind, classes, trees=5, depth=4)
    groups = [data(n, seed=n) for n in (60, 1, 7, 130)]
    cuts = [[T.thresholds(x[:, f]) for f in range(4)] for x, _, _ in groups]
    ys = [target(y, classes) for _, y, _ in groups]
    inits = [T.start(plan, len(y), y.sum(), ((y - y.mean()) ** 2).sum(), np.bincount(y.astype(int), minlength=classes).astype(float) if classes else np.zeros(0)) for y in ys]
    bins, of = np.concatenate([T.binned(x, c) for (x, _, _), c in zip(groups, cuts)]), np.repeat(np.arange(4), [60, 1, 7, 130])
    slots = T.slots_of([max(c, key=len) for c in zip(*cuts)])
    both = T.grown_batch(plan, bins, np.concatenate(ys), np.concatenate([h for _, _, h in groups]), of, slots, inits)
    for k, (x, _, h) in enumerate(groups):
        alone = [T.as_arrays(g.model(cuts[k]), plan.outputs) for g in T.grown(plan, x, ys[k], h, cuts[k], inits[k])]
        mine = [T.as_arrays(g.model(cuts[k], k), plan.outputs) for g in both]
        assert sum(len(m["roots"]) for m in mine) == sum(len(m["roots"]) for m in alone)
        assert np.allclose(T.summed(mine, x), T.summed(alone, x), atol=1e-9)


def test_a_level_holds_cells_of_rows_only():
    """Deep levels cost what their rows do, not nodes times bins."""
    x, y, h = data(400)
    plan = T.Plan("rf", trees=3, depth=8)
    cuts = [T.thresholds(x[:, f]) for f in range(4)]
    bins, slots = T.binned(x, cuts), T.slots_of(cuts)
    g = T.Grower(plan, 0, 3)
    g.begin([T.start(plan, len(y), y.sum(), ((y - y.mean()) ** 2).sum(), np.zeros(0))])
    node, row, stats = g.live(bins, y, h)
    while g.node["open"].any():
        cell, sums = g.cells(bins, slots, (node, row, stats))
        assert (np.diff(cell) > 0).all() and len(cell) <= 4 * len(row) and (sums[0] > 0).all()
        assert np.isclose(sums[0].sum(), 4 * stats[0].sum()) and np.isclose(sums[1].sum(), 4 * stats[1].sum())
        g.level(cell, sums, slots)
        node = g.step(bins, node, row)
        keep = np.flatnonzero(g.node["open"][node])
        node, row, stats = node[keep], row[keep], [v[keep] for v in stats]


@pytest.mark.parametrize("kind,classes", [("rf", 0), ("gbt", 0), ("rf", 3), ("gbt", 3)])
def test_attributions_from_tables_equal_those_by_leaves(kind, classes):
    x, y, h = data(90)
    plan = T.Plan(kind, classes, trees=6, depth=5)
    models = one_group(plan, x, target(y, classes), h)
    want = sum(T.tree_attribution(m, x, root) for m in models for root in m["roots"])
    got = T.grid_attributions(T.joined(models)[0], x)
    assert got is not None and np.allclose(got, want, atol=1e-9)
    assert np.allclose(T.attributions(models, x), want, atol=1e-9)


def test_known_sums_stand_for_earlier_rounds():
    x, y, h = data(80)
    plan = T.Plan("gbt", 3, trees=7, depth=2)
    t = target(y, 3)
    cuts = [T.thresholds(x[:, f]) for f in range(4)]
    g = T.grown(plan, x, t, h, cuts, T.start(plan, 80, 0, 0, np.bincount(t.astype(int)).astype(float)))[0]
    bins = T.binned(x, cuts)
    g.rounds = 4
    half = g.raw(bins)
    g.rounds = 8
    assert np.array_equal(g.raw(bins, half, 3), g.raw(bins)) and not np.allclose(half, g.raw(bins))


def test_boosting_grows_larger_groups_in_one_task_within_bounds(spark, monkeypatch):
    """A group beyond GROUP_ROWS is boosted in one task while rows and rows times features times outputs keep to their bounds; a forest is not."""
    rows = lambda plan, features: spark.range(1).select(T.rows_in_one_task(plan, F.lit(features)).alias("n")).first()["n"]
    assert rows(T.Plan("rf", 4), 8) == T.GROUP_ROWS
    assert rows(T.Plan("gbt", 4), 8) == 400_000 and rows(T.Plan("gbt", 4), 16) == 250_000
    assert rows(T.Plan("gbt", 4), 10_000) == T.GROUP_ROWS and rows(T.Plan("gbt", 2), 0) == 400_000
    x, y, _ = data(120)
    df = spark.createDataFrame([("g", k, x[k].tolist(), float(y[k])) for k in range(120)], "g string, id bigint, vec array<double>, y double")
    chunked = []
    fit = T.fit_chunked
    monkeypatch.setattr(T, "fit_chunked", lambda *a: chunked.append(a[3].kind) or fit(*a))
    monkeypatch.setattr(T, "GROUP_ROWS", 50)
    for kind in ("gbt", "rf"):
        T.fit_trees(df, ["g"], "id", "vec", "y", T.Plan(kind, trees=2, depth=2)).count()
    assert chunked == ["rf"]
    monkeypatch.setattr(T, "BOOST_NUMBERS", 119 * 4)
    T.fit_trees(df, ["g"], "id", "vec", "y", T.Plan("gbt", trees=2, depth=2)).count()
    assert chunked == ["rf", "gbt"]


def test_histogram_counted_and_sorted_agree():
    """The two ways to fill the cells of a level give the same cells and sums."""
    x, y, h = data(60)
    cuts = [T.thresholds(x[:, f]) for f in range(4)]
    bins, slots = T.binned(x, cuts), T.slots_of(cuts)
    for plan in (T.Plan("rf", trees=5), T.Plan("gbt", 3, trees=5)):
        g = T.Grower(plan, 0, 5)
        g.begin([T.start(plan, 60, y.sum(), 60.0, np.full(plan.classes, 20.0))])
        live = g.live(bins, target(y, plan.classes), h)
        cell, sums = g.cells(bins, slots, live)
        few = [v[:3] for v in (live[0], live[1])]
        want = {}
        for i, (node, row) in enumerate(zip(live[0], live[1])):
            for f in range(4):
                key = list(g.opened()).index(node) * int(slots[-1]) + int(slots[f] + bins[row, f])
                want[key] = want.get(key, 0) + np.array([v[i] for v in live[2]])
        assert cell.tolist() == sorted(want) and np.allclose(np.stack(sums, 1), [want[k] for k in sorted(want)])
        some, part = g.cells(bins, slots, (few[0], few[1], [v[:3] for v in live[2]]))  # mostly empty: sorted rows
        assert set(some) <= set(cell) and len(some) <= 12 and np.isclose(part[0].sum(), 4 * live[2][0][:3].sum())


def counted(monkeypatch, name):
    """Sizes of the first argument of all calls of a numpy function."""
    seen, fn = [], getattr(np, name)
    monkeypatch.setattr(np, name, lambda a, *k, **w: seen.append(np.size(a)) or fn(a, *k, **w))
    return seen


@pytest.mark.parametrize("kind,classes", [("rf", 0), ("rf", 3), ("gbt", 0), ("gbt", 3), ("gbt", 2)])
def test_growing_along_lanes_equals_growing_from_histograms(kind, classes):
    """Trees grown in memory are those of the histograms of all levels, node by node."""
    x, y, h = data(300)
    x[:, 2] = np.random.default_rng(3).normal(size=300)  # a feature of many bins, sorted at deep levels
    y = target(y, classes)
    plan = T.Plan(kind, classes, trees=5, depth=6 if kind == "rf" else 3)
    per = np.bincount(y.astype(int), minlength=classes).astype(float) if classes else np.zeros(0)
    init = T.start(plan, 300, y.sum(), ((y - y.mean()) ** 2).sum(), per)
    cuts = [T.thresholds(x[:, f]) for f in range(4)]
    bins, slots = T.binned(x, cuts), T.slots_of(cuts)
    g = T.Grower(plan, 0, 5)
    g.begin([init])
    while True:
        node, row, stats = g.live(bins, y, h)
        while g.node["open"].any():
            g.level(*g.cells(bins, slots, (node, row, stats)), slots)
            node = g.step(bins, node, row)
            keep = np.flatnonzero(g.node["open"][node])
            node, row, stats = node[keep], row[keep], [v[keep] for v in stats]
        if g.done:
            break
        g.plant()
    (got,) = T.grown(plan, x, y, h, cuts, init)
    want, mine = g.model(cuts), got.model(cuts)
    assert all(np.array_equal(want[k], mine[k]) for k in ("roots", "feature", "threshold", "left", "right"))
    assert np.allclose(want["value"], mine["value"], atol=1e-9) and np.allclose(want["cover"], mine["cover"])
    if kind == "rf" and classes:  # counts: equal leaves have equal values to the last bit, so that equal rows tie
        assert np.array_equal(want["value"], mine["value"])


def test_a_forest_in_memory_sorts_a_feature_once_a_tree(monkeypatch):
    """Levels do not sort (row, feature) pairs again: the lanes keep their order."""
    x, y, h = data(400)
    plan = T.Plan("rf", trees=3, depth=8)
    cuts = [T.thresholds(x[:, f]) for f in range(4)]
    sizes = counted(monkeypatch, "sort")
    T.grown(plan, x, y, h, cuts, T.start(plan, 400, y.sum(), ((y - y.mean()) ** 2).sum(), np.zeros(0)))
    assert sum(sizes) <= 4 * 3 * 400


def test_nodes_of_later_rounds_copy_no_earlier_ones():
    """Boosting appends its nodes in place: an array of them is copied when it doubles, not each level."""
    x, y, h = data(50)
    g = T.Grower(T.Plan("gbt", trees=200, depth=3), 0, 200)
    g.begin([T.start(g.plan, 50, y.sum(), 50.0, np.zeros(0))])
    places = set()
    for _ in range(199):
        g.plant()
        places.add(id(g.node["feature"].base))
    assert g.node["feature"].base is not None and len(g.cover) == 200 and len(places) <= 10 and (g.node["path"] == 1).all() and (np.diff(g.node["tree"]) == 1).all()


def by_hand(T, plan, x, y, h, cuts, init, looked):
    """A class forest from the cells of two chunks a level; the grower, cells seen and levels."""
    g, bins, slots = T.Grower(plan, 0, plan.trees), T.binned(x, cuts), T.slots_of(cuts)
    g.begin([init])
    seen = levels = 0
    while g.node["open"].any():
        sums = {}
        for part in (slice(0, len(y) // 3), slice(len(y) // 3, None)):
            if looked:
                cell, got = g.class_cells(np.asfortranarray(bins[part]), slots, y[part], h[part])
            else:
                node, row, stats = g.live(bins[part], y[part], h[part])
                node = g.route(bins[part], node, row)
                keep = np.flatnonzero(g.node["open"][node])
                cell, got = g.cells(bins[part], slots, (node[keep], row[keep], [v[keep] for v in stats]))
            for k, c in enumerate(cell):
                sums[c] = sums.get(c, 0) + np.array([v[k] for v in got])
        cell = np.array(sorted(sums), np.int64)
        seen, levels = seen + len(cell), levels + 1
        g.level(cell, list(np.array([sums[c] for c in cell]).reshape(len(cell), -1).T), slots, looked)
    return g, seen, levels


@pytest.mark.parametrize("classes", [2, 3])
def test_a_level_counts_only_the_features_its_nodes_look_at(classes):
    """Cells of the sqrt(p) features a node looks at give the trees that those of all features give, indicators that rule each other out and constants included."""
    x, y, h = data(200, 9, 5)
    size = np.random.default_rng(2).integers(0, 3, 200)
    x[:, 1:4] = size[:, None] == np.arange(3)
    x[:, 4] = 7.0
    x[:, 5] = np.where(x[:, 0] > 0, x[:, 5], 0)
    y = target(y, classes)
    plan = T.Plan("rf", classes, trees=12, depth=6)
    cuts = [T.thresholds(x[:, f]) for f in range(9)]
    init = T.start(plan, 200, 0, 0, np.bincount(y.astype(int), minlength=classes).astype(float))
    all_of, n_all, _ = by_hand(T, plan, x, y, h, cuts, init, False)
    some, n_some, levels = by_hand(T, plan, x, y, h, cuts, init, True)
    key = lambda g: {(t, p): (f, b, c, tuple(v)) for t, p, f, b, c, v in zip(g.node["tree"], g.node["path"], g.node["feature"], g.node["bin"], g.cover, g.value)}
    assert key(all_of) == key(some) and levels > 6  # some nodes looked again
    assert n_some < 0.7 * n_all
    (alone,) = T.grown(plan, x, y, h, cuts, init)
    assert {k: v[:3] for k, v in key(alone).items()} == {k: v[:3] for k, v in key(some).items()}


def test_a_chunked_forest_looks_again_where_features_are_constant(spark):
    r = np.random.default_rng(4)
    size, v = r.integers(0, 3, 300), r.normal(size=300)
    rows = [("g", k, [float(v[k]), *[float(size[k] == c) for c in range(3)], 1.0], float((v[k] > 0) ^ (size[k] == 1))) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, id bigint, vec array<double>, y double")
    plan = T.Plan("rf", 2, trees=3, depth=4)
    use = lambda m: {q.id: q.prediction for q in T.predict(df, m, ["g"], "id", "vec", plan).collect()}
    one, many = (use(T.fit_trees(df, ["g"], "id", "vec", "y", plan, group_rows=n)) for n in (1000, 50))
    assert len(one) == 300 and all(np.allclose(one[k], many[k], atol=1e-12) for k in one)


def test_grid_of_a_small_group_equals_the_one_of_the_table(spark):
    r = np.random.default_rng(6)
    held = {"few": r.integers(0, 40, 900).astype(float), "edge": np.arange(256.0), "over": np.arange(257.0), "ties": np.round(r.normal(size=1900), 2),
            "many": r.normal(size=2500), "zero": np.array([0.0, -0.0, 1.0]), "one": np.array([3.0])}
    rows = [(g, [float(v)]) for g, x in held.items() for v in r.permutation(x)]
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(5)
    for q in T.grids(df, ["g"], "v").collect():
        assert np.array_equal(T.thresholds(q.grid[0]), T.thresholds(T.grid_of(held[q.g]))), q.g  # -0.0 and 0.0 are one value


def test_trees_of_a_chunked_forest_are_not_broadcast(spark, monkeypatch):
    sent, real = [], T.F.broadcast
    monkeypatch.setattr(T.F, "broadcast", lambda df: sent.append(df.columns) or real(df))
    r = np.random.default_rng(2)
    rows = [("a", k, r.normal(size=3).round(1).tolist(), float(k % 3)) for k in range(90)]
    df = spark.createDataFrame(rows, "g string, id bigint, vec array<double>, y double")
    models = T.fit_trees(df, ["g"], "id", "vec", "y", T.Plan("rf", 3, trees=3, depth=3), group_rows=20)
    assert models.count() == 1 and sent and all({"feature", "open"}.isdisjoint(c) for c in sent)
