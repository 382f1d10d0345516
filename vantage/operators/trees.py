"""Tree ensembles for every group at once: forests, boosting, predictions, attributions.

Features are binned per group (every distinct value a bin while there are at
most ``bins`` of them, quantiles beyond), so a split is found from a histogram
of weight and target sums per (node, feature, bin).  ``Grower`` holds the
nodes of one block of trees and takes the non-empty cells of a whole level's
histogram at a time; how they come about is the only difference between the two
ways to grow:

* a group of up to ``group_rows`` rows is grown in one task, all levels, small
  groups a batch at a time; boosting, of hundreds of short levels one after the
  other, does so for groups of up to ``BOOST_ROWS`` rows and ``BOOST_NUMBERS``
  bins (rows times features times outputs), which bounds a task's memory and time;
* a larger group stays in chunks: per level, each chunk routes its rows
  through the trees so far and returns its non-empty histogram cells, one
  grouped sum adds them up for all groups and trees, and one small task per
  (group, block of trees) picks the splits.  Boosting runs its rounds the same
  way, the residuals recomputed from the trees so far.

Rows are weighted by Poisson(1) draws from a hash of (row, tree) instead of
drawn with replacement, and a classification forest looks at sqrt(p) features
a node, in an order hashed from (tree, node): results do not depend on
partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.operators.chunked import CHUNK_ROWS, apply_models, each_row, packed, spread, write_once
from vantage.session import ship_package

BINS, GROUP_ROWS, BLOCK_TREES = 256, 50_000, 25
#: (tree, row) pairs that are grown at once in a task, about; groups are batched and blocks of trees cut to it.
LIVE_PAIRS = 100_000
#: Rows and (row, feature, output) triples of a group that is boosted in one task, at most.
BOOST_ROWS, BOOST_NUMBERS = 400_000, 16_000_000
#: Rounds after which boosting over chunks writes down the sums of the trees so far.
RENEW_ROUNDS = 10
#: Rows of the small groups that are sent to one call together, about.
LOT_ROWS = 10_000
#: Rows of a group up to which Spark's approximate quantiles, at the accuracy of ``grids``, are exact ones.
EXACT_ROWS = 2500
#: Numbers a level's histogram may hold; blocks of trees are made smaller to keep to it.
LEVEL_CELLS = 8_000_000
#: Features up to which a forest's nodes remember those that cannot split them (a bit each); beyond, a level counts all features.
KNOWN_FEATURES = 62
#: Rows that are attributed at once.
EXPLAIN_ROWS = 2000
#: Rows of a chunk of a forest's group at most: larger chunks have fewer cells in common.
FOREST_CHUNK_ROWS = 32_768


@dataclass
class Plan:
    """What to grow.  ``kind`` 'rf' or 'gbt'; ``classes`` 0 for regression; defaults follow the usual library ones but for the forest's depth."""

    kind: str
    classes: int = 0
    trees: int = 100
    depth: int = 8
    rate: float = 0.1
    min_leaf: int = 1
    seed: int = 42

    @property
    def outputs(self) -> int:
        return 1 if not self.classes or (self.kind == "gbt" and self.classes == 2) else self.classes


def mixed(*parts) -> np.ndarray:
    """64-bit hash of whole numbers, elementwise (a multiply-xor-shift mix)."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (np.asarray(p).astype(np.int64).astype(np.uint64) ^ h) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            h = h ^ (h >> np.uint64(29))
    return h


_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(12)])


def draws(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of each row in a tree."""
    share = mixed(h, tree, seed).astype(np.float64) / 2.0**64
    out, top = np.zeros(share.shape), share.max(initial=0.0)
    for step in _POISSON[_POISSON <= top]:
        out += share >= step
    return out


def thresholds(values: Sequence[float]) -> np.ndarray:
    """Split points between neighbouring values; ``x <= t`` goes left."""
    v = np.unique(np.asarray(values, float))
    mid = v[:-1] + (v[1:] - v[:-1]) / 2
    return np.where(mid < v[1:], mid, v[:-1])


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of the rows, a column in one piece each."""
    return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]).astype(np.int64).T if x.size else np.zeros(x.shape, np.int64)


def smallest(bins: np.ndarray) -> type:
    """A short kind of number that holds the bins."""
    return np.uint16 if bins.max(initial=0) < 1 << 16 else np.int64


def slots_of(cuts: list[np.ndarray]) -> np.ndarray:
    """Where the bins of each feature begin among all bins of a node, and how many these are."""
    return np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])]).astype(np.int64)


# ---- nodes --------------------------------------------------------------------------------------------------

_NODE = {"feature": np.int32, "bin": np.int32, "left": np.int32, "right": np.int32, "tree": np.int32, "level": np.int32, "path": np.int64, "unable": np.int64, "open": np.int8}


class Live:
    """Bins of the live rows of trees in memory, ``(feature, live row)``, and what a round of boosting finds at the roots that the next ones can use."""

    def __init__(self, bins: np.ndarray, row: np.ndarray, slots: np.ndarray) -> None:
        self.widths = np.diff(slots).tolist()
        self.held = np.stack([bins[:, f].take(row) for f in range(bins.shape[1])]) if bins.shape[1] else np.zeros((0, len(row)), bins.dtype)
        self.flat = self.held.ravel()
        self.share: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


@dataclass
class Grower:
    """Nodes of the trees ``first .. first + count`` of a plan; stats per node are weight, target sums, and what leaf values divide by.

    Holds one group or several with features in common; tree t of group g is number ``g * stride + t``.
    """

    plan: Plan
    first: int
    count: int
    node: dict[str, np.ndarray] = field(default_factory=lambda: {k: np.zeros(0, t) for k, t in _NODE.items()})
    value: np.ndarray | None = None
    cover: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: np.ndarray | None = None
    scale: np.ndarray = field(default_factory=lambda: np.ones(1))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(1))
    rounds: int = 0
    planted: int = 0  # no node before it is open
    room: dict[str, np.ndarray] = field(default_factory=dict)

    # -- layout

    @property
    def k(self) -> int:
        return self.plan.outputs

    @property
    def stride(self) -> int:
        return self.plan.trees * self.k

    @property
    def stats(self) -> int:
        """Sums a histogram cell holds: weight and targets, or weight, residual and its divisor."""
        return self.k + 1 if self.plan.kind == "rf" else 3

    def begin(self, inits: Sequence[tuple[np.ndarray, float, float]]) -> None:
        """Start each group from the bias, the scale and the centre that ``start`` gives."""
        self.bias, self.scale, self.centre = np.array([i[0] for i in inits], float), np.array([i[1] for i in inits], float), np.array([i[2] for i in inits], float)
        self.value = np.zeros((0, self.k))
        self.plant()

    def plant(self) -> None:
        """Open the roots of each group's next trees: all of a forest's, one per output for a boosting round."""
        n, at = (self.count, self.first) if self.plan.kind == "rf" else (self.k, self.rounds * self.k)
        tree = (np.arange(len(self.scale))[:, None] * self.stride + at + np.arange(n)[None, :]).ravel()
        self.planted = len(self.cover)
        self.add(len(tree), {"tree": tree, "path": np.ones(len(tree)), "open": np.ones(len(tree))})
        self.rounds += 1

    def roots(self) -> np.ndarray:
        """Roots planted last, ``(group, tree)``."""
        at = self.planted + np.flatnonzero(self.node["path"][self.planted:] == 1)
        return at.reshape(-1, len(self.scale), self.count if self.plan.kind == "rf" else self.k)[-1]

    def add(self, n: int, cols: dict) -> np.ndarray:
        """Append ``n`` nodes and return their numbers."""
        at = len(self.cover)
        for name, kind in _NODE.items():
            empty = -1 if name in ("feature", "left", "right") else 0
            self.node[name] = self.longer(name, self.node[name], n)
            self.node[name][at:] = np.asarray(cols.get(name, empty)).astype(kind)
        self.value, self.cover = self.longer("value", self.value, n), self.longer("cover", self.cover, n)
        self.value[at:] = self.cover[at:] = 0
        return np.arange(at, at + n)

    def longer(self, name: str, v: np.ndarray, n: int) -> np.ndarray:
        """``v`` with ``n`` more places, from an array that doubles when it is full."""
        size, room = len(v) + n, self.room.get(name)
        if room is None or len(room) < size:
            room = self.room[name] = np.empty((2 * size, *v.shape[1:]), v.dtype)
            room[:len(v)] = v
        return room[:size]

    def opened(self) -> np.ndarray:
        return self.planted + np.flatnonzero(self.node["open"][self.planted:])

    @property
    def done(self) -> bool:
        return not self.node["open"][self.planted:].any() and (self.plan.kind == "rf" or self.rounds >= self.plan.trees)

    # -- rows

    def step(self, bins: np.ndarray, node: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Node one level down from where each row is; a node without a split keeps its rows."""
        f = self.node["feature"][node]
        left = bins[row, np.maximum(f, 0)] <= self.node["bin"][node]
        return np.where(f < 0, node, np.where(left, self.node["left"][node], self.node["right"][node]))

    def route(self, bins: np.ndarray, roots: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Node that each (root, row) reaches."""
        at, n, feature = np.array(roots), len(bins), self.node["feature"]
        ends, flat, own = feature < 0, bins.ravel("F"), np.arange(len(feature))  # a node without a split keeps its rows
        kids = np.stack([np.where(ends, own, self.node["right"]), np.where(ends, own, self.node["left"])], 1).ravel()
        begin = np.where(ends, 0, feature).astype(np.int64) * n
        while not ends.take(at).all():
            at = kids.take(2 * at + (flat.take(begin.take(at) + row) <= self.node["bin"].take(at)))
        return at

    def raw(self, bins: np.ndarray, known: np.ndarray | None = None, since: int = 0) -> np.ndarray:
        """Sum of the bias and the values of all trees of earlier boosting rounds for each row of a grower's only group; ``known`` has those before round ``since``."""
        out = np.tile(self.bias[0], (len(bins), 1)) if known is None else known.copy()
        roots = np.flatnonzero((self.node["path"] == 1) & (self.node["tree"] < (self.rounds - 1) * self.k) & (self.node["tree"] >= since * self.k))
        size = max(1, LIVE_PAIRS // max(len(bins), 1))
        for a in range(0, len(roots), size):
            some = roots[a:a + size]
            at = self.route(bins, np.repeat(some, len(bins)), np.tile(np.arange(len(bins)), len(some)))
            for values in self.value[at].reshape(len(some), len(bins), self.k):
                out += values
        return out

    def live(self, bins: np.ndarray, y: np.ndarray, h: np.ndarray, raw: np.ndarray | None = None, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(node, row, stats) of every row in every tree planted last, at the tree's root; ``raw`` and the rows' ``group`` if known."""
        p, n, roots = self.plan, len(bins), self.roots()
        group = np.zeros(n, np.int64) if group is None else group
        if p.kind == "rf":
            trees = self.first + np.arange(self.count)
            w = draws(h[None, :], trees[:, None], p.seed)
            tree, row = np.nonzero(w)
            w = w[tree, row]
            target = one_hot(y, p.classes) if p.classes else ((y - self.centre[group]) / self.scale[group])[:, None]
            return roots[group[row], tree], row, [w, *[w * t[row] for t in target.T]]
        raw = self.raw(bins) if raw is None else raw
        res, hess = residuals(raw, y, p.classes)
        res = res / self.scale[group][:, None]
        return roots[group].T.ravel(), np.tile(np.arange(n), self.k), [np.ones(n * self.k), res.T.ravel(), hess.T.ravel()]

    def cells(self, bins: np.ndarray, slots: np.ndarray, live: tuple[np.ndarray, np.ndarray, list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Non-empty cells of the histogram of the live rows: numbers ``(open node, slot of feature and bin)`` in order, and their sums.

        Counted in a table of all cells, or where that would be mostly empty (deep levels) from the sorted rows.
        """
        opened = self.opened()
        at = np.zeros(len(self.cover), np.int64)
        at[opened] = np.arange(len(opened))
        node, row, stats = live
        width, n_features = int(slots[-1]), bins.shape[1]
        own = at[node]
        if not len(row):
            return np.zeros(0, np.int64), [np.zeros(0) for _ in stats]
        if len(opened) * width <= 2 * len(row) * n_features:
            ones = self.plan.kind == "gbt"  # every row weighs 1
            table = np.empty((len(stats), len(opened), width))
            for f in range(n_features):  # a feature at a time: no array of all pairs and features
                a, b = int(slots[f]), int(slots[f + 1])
                key = own * (b - a) + bins[:, f].take(row)
                for s, v in enumerate(stats):
                    table[s, :, a:b] = np.bincount(key, None if ones and s == 0 else v, len(opened) * (b - a)).reshape(-1, b - a)
            held = np.flatnonzero(table[0])  # weights are 1 at least
            return held, [t.ravel()[held] for t in table]
        key = np.concatenate([own * width + (bins[:, f].take(row) + slots[f]) for f in range(n_features)])
        bits = int(len(key) - 1).bit_length()
        both = np.sort((key << bits) | np.arange(len(key)))
        key, order = both >> bits, (both & ((1 << bits) - 1)) % len(node)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[begin], [np.add.reduceat(v[order], begin) for v in stats]

    def own_order(self, n_features: int) -> np.ndarray:
        """The order in which each open node looks at the features."""
        opened = self.opened()
        tree = self.node["tree"][opened] % self.stride
        return np.argsort(mixed(tree[:, None], self.node["path"][opened][:, None], np.arange(n_features)[None, :], self.plan.seed), axis=1)

    def looked_at(self, n_features: int) -> tuple[np.ndarray, np.ndarray]:
        """What a level counts of each open node: its first sqrt(p) features, in its own order, that are not known to be unable to split it; and whether others are left."""
        may = (self.node["unable"][self.opened()][:, None] >> np.arange(n_features)) & 1 == 0
        order = self.own_order(n_features)
        first = np.take_along_axis(may, order, 1)
        first &= np.cumsum(first, 1) <= max(1, int(np.sqrt(n_features)))
        look = np.zeros_like(may)
        np.put_along_axis(look, order, first, 1)
        return look, (may & ~look).any(1)

    def class_cells(self, bins: np.ndarray, slots: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Non-empty cells, as of ``cells``, of what the open nodes of a class forest look at: one count over (node, bin, class) a feature."""
        p, opened, width = self.plan, self.opened(), int(slots[-1])
        trees = np.unique(self.node["tree"][opened])
        w = draws(h[None, :], trees[:, None], p.seed)
        tree, row = np.nonzero(w)
        at = np.full(len(self.cover), -1)
        at[opened] = np.arange(len(opened))
        own = at.take(self.route(bins, self.roots()[0][trees - self.first].take(tree), row))
        live = np.flatnonzero(own >= 0)
        w, own, row = w[tree, row].take(live), own.take(live), row.take(live)
        of, cell, sums = y.astype(np.int64).take(row), [np.zeros(0, np.int64)], [np.zeros((0, p.classes))]
        for f, look in enumerate(self.looked_at(bins.shape[1])[0].T):
            size, mine = int(slots[f + 1] - slots[f]), np.flatnonzero(look)
            go = np.flatnonzero(look.take(own))
            key = (np.cumsum(look) - 1).take(own.take(go)) * size + bins[:, f].take(row.take(go))
            if len(mine) * size <= 2 * len(go):
                found = np.arange(len(mine) * size)
            else:  # mostly empty
                found, key = np.unique(key, return_inverse=True)
            table = np.bincount(key * p.classes + of.take(go), w.take(go), len(found) * p.classes).reshape(-1, p.classes)
            held = np.flatnonzero(table.any(1))
            cell.append(mine[found[held] // size] * width + slots[f] + found[held] % size)
            sums.append(table[held])
        table = np.concatenate(sums)
        return np.concatenate(cell), [table.sum(1), *table.T]

    # -- a level

    def level(self, cell: np.ndarray, sums: list[np.ndarray], slots: np.ndarray, looked: bool = False) -> None:
        """Split or close every open node, given the non-empty cells of the histogram of all rows, in order.

        With ``looked`` the cells are those of ``looked_at``: a node where a feature of these turns out
        to be unable to split it, and others are left, stays open and looks at the next ones.
        """
        p, opened = self.plan, self.opened()
        width, n_features, n_open = int(slots[-1]), len(slots) - 1, len(opened)
        n_sums = len(sums) - 1 if p.kind == "rf" else 1
        total, best = np.zeros((n_open, self.stats)), np.full((n_open, n_features), -np.inf)
        where, lstats = np.zeros((n_open, n_features), np.int64), np.zeros((n_open, n_features, self.stats))
        if len(cell):
            own = cell // width
            slot = cell - own * width
            part = own * n_features + np.repeat(np.arange(n_features), np.diff(slots))[slot]
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            size = np.diff(np.append(begin, len(cell)))
            node_of, feature_of = own[begin], part[begin] % n_features
            left, lead = [], np.concatenate([[True], node_of[1:] != node_of[:-1]])
            for s, v in enumerate(sums):
                whole = np.add.reduceat(v, begin)
                total[node_of[lead], s] = whole[lead]
                v = v.copy()
                v[begin[1:]] -= whole[:-1]  # running sums begin anew in each (node, feature), up to rounding
                run = np.cumsum(v)
                run -= np.repeat(run[begin] - sums[s][begin], size)
                left.append(run)
            weight = total[node_of, 0]
            wl = left[0]
            wr = np.repeat(weight, size) - wl
            fits = (wl >= p.min_leaf - 1e-9) & (wr >= p.min_leaf - 1e-9)
            on_left, on_right, before = np.zeros(len(cell)), np.zeros(len(cell)), np.zeros(len(begin))
            for s in range(1, 1 + n_sums):
                t = total[node_of, s]
                on_left += left[s] * left[s]
                rest = np.repeat(t, size) - left[s]
                on_right += rest * rest
                before += t * t
            after = np.where(fits, on_left / np.where(fits, wl, 1) + on_right / np.where(fits, wr, 1), -np.inf)
            top = np.maximum.reduceat(after, begin)
            # equal gains go to the first bin and feature: those within rounding of the best count as equal
            near = np.flatnonzero(after >= np.repeat(top - 1e-10 * np.abs(weight), size))
            of = np.repeat(np.arange(len(begin)), size)[near]
            at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            first = near[at]
            gain = after[first] - before / np.where(weight > 0, weight, 1)
            best[node_of, feature_of] = gain
            where[node_of, feature_of] = slot[first] - slots[feature_of]
            for s in range(self.stats):
                lstats[node_of, feature_of, s] = left[s][first]
        again = None
        if looked:
            look, left_over = self.looked_at(n_features)
            unable = look & ~np.isfinite(best)
            self.node["unable"][opened] |= (unable.astype(np.int64) << np.arange(n_features)).sum(1)
            again = unable.any(1) & left_over
        self.divide(total, best, where, lstats, again)

    def divide(self, total: np.ndarray, best: np.ndarray, where: np.ndarray, lstats: np.ndarray, again: np.ndarray | None = None) -> None:
        """Split or close every open node, given its sums and per feature the gain, the bin and the left sums of the best split."""
        p, opened = self.plan, self.opened()
        n_open, n_features = best.shape
        self.cover[opened] = total[:, 0]
        if p.kind == "rf" and p.classes:  # the first sqrt(p) features, in the node's own order, that can split at all
            order = self.own_order(n_features)
            able = np.take_along_axis(np.isfinite(best), order, 1)
            chosen = able & (np.cumsum(able, 1) <= max(1, int(np.sqrt(n_features))))
            mask = np.zeros_like(chosen)
            np.put_along_axis(mask, order, chosen, 1)
            best = np.where(mask, best, -np.inf)
        feature = np.argmax(best >= best.max(1, keepdims=True) - 1e-10 * np.abs(total[:, :1]), axis=1)
        i = np.arange(n_open)
        # a split must lower the impurity, but for a forest's classes any valid split of an impure node goes
        split = best[i, feature] > 1e-10 * np.maximum(total[:, 0], 1)
        lstat = lstats[i, feature]
        rstat = total - lstat
        self.node["open"][opened] = 0
        if again is not None:
            split &= ~again
            self.node["open"][opened[again]] = 1
        self.values(opened, total)
        at = np.flatnonzero(split)
        if not len(at):
            return
        parent = opened[at]
        level = self.node["level"][parent] + 1
        kids = {}
        for side, stat, bit in (("left", lstat[at], 0), ("right", rstat[at], 1)):
            more = ((level < p.depth) & (stat[:, 0] >= 2 * p.min_leaf)).astype(np.int8)
            if p.kind == "rf" and p.classes:
                more &= (stat[:, 1:] > 0.5).sum(1) > 1  # whole weights: nothing to tell apart in a node of one class
            kids[side] = self.add(len(at), {"tree": self.node["tree"][parent], "level": level, "path": 2 * self.node["path"][parent] + bit,
                                            "unable": self.node["unable"][parent], "open": more})
            self.cover[kids[side]] = stat[:, 0]
            self.values(kids[side], stat)
        self.node["feature"][parent], self.node["bin"][parent] = feature[at], where[at, feature[at]]
        self.node["left"][parent], self.node["right"][parent] = kids["left"], kids["right"]

    def values(self, nodes: np.ndarray, stats: np.ndarray) -> None:
        p = self.plan
        scale = self.scale[self.node["tree"][nodes] // self.stride]
        if p.kind == "rf":
            w = np.maximum(stats[:, 0], 1e-300)[:, None]
            self.value[nodes] = stats[:, 1:] / w * (1.0 if p.classes else scale[:, None]) / p.trees
            return
        factor = p.rate * scale * ((p.classes - 1) / p.classes if p.classes > 2 else 1.0)
        step = np.where(np.abs(stats[:, 2]) > 1e-150, factor * stats[:, 1] / np.where(np.abs(stats[:, 2]) > 1e-150, stats[:, 2], 1), 0.0)
        self.value[nodes] = 0.0
        self.value[nodes, self.node["tree"][nodes] % self.k] = step

    # -- all levels in memory

    def deepen(self, live: Live, node: np.ndarray, stats: list[np.ndarray]) -> np.ndarray | None:
        """Grow the trees planted last to their leaves; for boosting, the node that each live row ends in.

        A feature of few bins beside the rows of a node is counted in a table
        of (open node, bin).  Beyond, a lane holds the live rows in the order of
        (open node, bin), and running sums along it tell the same; handing rows
        to the children, left ones before right ones as the nodes are numbered,
        keeps the order, so that a feature is sorted once a tree.
        """
        p, n_features, boosts = self.plan, len(live.held), self.plan.kind == "gbt"
        opened, leaf, n_live = self.opened(), node.copy() if boosts else None, len(node)
        n_sums = 1 if boosts else len(stats) - 1
        first, of = np.argsort(node, kind="stable"), None
        of = (node - opened[0]).take(first)  # roots are numbered one after the other
        lanes: dict[int, np.ndarray] = {}
        # along a lane the weights of a forest's rows travel with the first sum, as one complex number: one running sum for both
        off, moved = [np.empty(n_live, float if boosts or s else complex) for s in range(n_sums)], np.empty(n_live, np.int8)
        root = True
        while len(opened):
            n_open = len(opened)
            held = [v.take(first) for v in stats]
            total = np.stack([np.bincount(of, None if boosts and s == 0 else v, n_open) for s, v in enumerate(held)], 1).astype(float)
            weight = total[:, 0]
            mean = total[:, 1:1 + n_sums] / np.maximum(weight, 1e-300)[:, None]
            around = [mean[:, s].take(of) for s in range(n_sums)]  # sums around the node's mean: they end at nought in each node
            around = [held[1 + s] - (v if boosts else held[0] * v) for s, v in enumerate(around)]
            best, where = np.full((n_open, n_features), -np.inf), np.zeros((n_open, n_features), np.int64)
            lstats = np.zeros((n_open, n_features, self.stats))
            before = same = None
            for f in range(n_features):
                width = live.widths[f]
                if f not in lanes and n_open * width <= (1 if boosts else 0.5) * len(first):
                    key = of * width + live.held[f].take(first)
                    table = lambda v, key=key, width=width: np.cumsum(np.bincount(key, v, n_open * width).reshape(-1, width), 1)
                    if root and f in live.share:
                        wl, share, able = live.share[f]
                    else:
                        wl = table(None if boosts else held[0])
                        wr = weight[:, None] - wl
                        valid = (wl >= p.min_leaf - 1e-9) & (wr >= p.min_leaf - 1e-9)
                        share = np.where(valid, weight[:, None] / np.where(valid, wl * wr, 1), 0.0)
                        able = valid.any(1)
                        if root and boosts:  # all rows weigh 1: the same in each round
                            live.share[f] = wl, share, able
                    left = [table(v) for v in around]
                    drop = left[0] * left[0]
                    for v in left[1:]:
                        drop += v * v
                    drop *= share
                    # equal gains go to the first bin: those within rounding of the best count as equal
                    pick = (drop >= (drop.max(1) - 1e-10 * weight)[:, None]).argmax(1)
                    at = np.arange(n_open) * width + pick
                    gain, who = np.where(able, drop.take(at), -np.inf), slice(None)
                    where[:, f] = pick
                    third = lambda: table(held[2]).take(at)  # noqa: B023, E731
                else:
                    if f not in lanes:
                        bits = int(max(len(first) - 1, 0)).bit_length()
                        key = (of * width + live.held[f].take(first)) << bits | np.arange(len(first))
                        lanes[f] = first.take(np.sort(key) & ((1 << bits) - 1))
                    if before is None:
                        before, same = np.cumsum(total, 0) - total, of[1:] == of[:-1]
                        for s, v in enumerate(around):
                            off[s][first] = v if boosts or s else held[0] + 1j * v
                    lane = lanes[f]
                    b = live.held[f].take(lane)
                    ends = np.flatnonzero((b[1:] != b[:-1]) & same)  # last places of bins that others of the node come after
                    if not len(ends):
                        continue
                    at, along = of.take(ends), lambda v, lane=lane, ends=ends: np.cumsum(v.take(lane)).take(ends)
                    left = [along(v) for v in off]
                    wl = (ends + 1.0 if boosts else left[0].real) - before[:, 0].take(at)
                    left[0] = left[0] if boosts else left[0].imag
                    all_w = weight.take(at)
                    wr = all_w - wl
                    drop = left[0] * left[0]
                    for v in left[1:]:
                        drop += v * v
                    drop *= all_w / (wl * wr)
                    if p.min_leaf > 1:
                        drop[(wl < p.min_leaf - 1e-9) | (wr < p.min_leaf - 1e-9)] = -np.inf
                    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    who, top = at.take(begin), np.empty(n_open)
                    top[who] = np.maximum.reduceat(drop, begin) - 1e-10 * weight.take(who)
                    near = np.flatnonzero(drop >= top.take(at))
                    of_near = at.take(near)
                    at = near[np.flatnonzero(np.concatenate([[True], of_near[1:] != of_near[:-1]]))]
                    gain = drop.take(at)
                    where[who, f] = b.take(ends.take(at))
                    third = lambda: along(stats[2]).take(at) - before[who, 2]  # noqa: B023, E731
                best[who, f] = gain
                lstats[who, f, 0] = wl.take(at)
                for s, v in enumerate(left):
                    lstats[who, f, 1 + s] = v.take(at) + wl.take(at) * mean[who, s]
                if boosts:  # what leaf values divide by
                    lstats[who, f, 2] = third() if p.classes else wl.take(at)
            if p.classes and not boosts:  # counts: equal ones give equal leaf values, to the last bit
                np.rint(lstats, out=lstats)
            self.divide(total, best, where, lstats)
            feature, last, root = self.node["feature"][opened], opened, False
            split = np.maximum(feature, 0) * n_live
            goes = live.flat.take(split.take(of) + first) <= self.node["bin"][last].take(of) if n_features else np.ones(len(of), bool)
            kids = np.stack([np.where(feature < 0, last, self.node[side][last]) for side in ("right", "left")], 1).ravel()
            turn = 2 * of + goes
            if boosts:
                leaf[first] = kids.take(turn)
            sizes = np.bincount(turn, minlength=len(kids))
            self.node["open"][kids[sizes == 1]] = 0  # one row is not split any more
            opened, is_open = self.opened(), self.node["open"][kids] > 0
            if not len(opened):
                break
            side = np.where(is_open, np.where(np.arange(len(kids)) % 2, 1, 2), 0).astype(np.int8).take(turn)
            if lanes:
                moved[first] = side
            of = np.repeat(np.arange(len(opened)), np.concatenate([sizes[1::2][is_open[1::2]], sizes[::2][is_open[::2]]]))
            halves = lambda v, side: np.concatenate([v.take(np.flatnonzero(side == 1)), v.take(np.flatnonzero(side == 2))])
            lanes = {f: halves(lane, moved.take(lane)) for f, lane in lanes.items()}
            first = next(iter(lanes.values())) if lanes else halves(first, side)
        return leaf

    # -- rows of a table

    def state(self) -> dict:
        """What a row of ``STATE`` holds of a grower with one group."""
        return {"first": self.first, "count": self.count, "rounds": self.rounds, "scale": float(self.scale[0]), "centre": float(self.centre[0]),
                "bias": self.bias[0].tolist(), "value": self.value.ravel().tolist(), "cover": self.cover.tolist(), **{k: v.tolist() for k, v in self.node.items()}}

    @staticmethod
    def of(plan: Plan, row: dict) -> Grower:
        g = Grower(plan, row["first"], row["count"])
        g.rounds, g.scale, g.centre, g.bias = row["rounds"], np.array([row["scale"]], float), np.array([row["centre"]], float), np.array([row["bias"]], float)
        g.cover = np.array(row["cover"], float)
        g.value = np.array(row["value"], float).reshape(len(g.cover), g.k)
        g.node = {k: np.array(row[k], t) for k, t in _NODE.items()}
        return g

    def model(self, cuts: list[np.ndarray], group: int = 0) -> dict:
        """Trees of a group, with thresholds in place of bins."""
        mine = np.flatnonzero(self.node["tree"] // self.stride == group)
        number = np.full(len(self.cover) + 1, -1, np.int32)  # the last one for no node
        number[mine] = np.arange(len(mine))
        f, b = self.node["feature"][mine], self.node["bin"][mine]
        flat, at = np.concatenate([*cuts, np.zeros(1)]), np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
        t = np.where(f >= 0, flat[np.where(f >= 0, at[f] + b, len(flat) - 1)], 0.0)
        return {"block": self.first, "bias": self.bias[group], "roots": np.flatnonzero(self.node["path"][mine] == 1).astype(np.int32), "feature": f, "threshold": t,
                "left": number[self.node["left"][mine]], "right": number[self.node["right"][mine]], "value": self.value[mine].ravel(), "cover": self.cover[mine]}


STATE = ("first int, count int, rounds int, scale double, centre double, bias array<double>, value array<double>, cover array<double>, feature array<int>, bin array<int>, "
         "left array<int>, right array<int>, tree array<int>, level array<int>, path array<bigint>, unable array<bigint>, open array<tinyint>")
#: What of a node a forest's rows do not need on their way to it.
UNROUTED = ["value", "cover", "level"]
MODEL = ("block int, bias array<double>, roots array<int>, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, "
         "cover array<double>")


def one_hot(y: np.ndarray, classes: int) -> np.ndarray:
    return (y[:, None] == np.arange(classes)[None, :]).astype(float)


def residuals(raw: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradient of the loss and what a leaf's sum of it is divided by."""
    if not classes:
        return y[:, None] - raw, np.ones_like(raw)
    if classes == 2:
        p = 1 / (1 + np.exp(-raw))
        r = y[:, None] - p
        return r, p * (1 - p)
    r = one_hot(y, classes) - softmax(raw)
    return r, np.abs(r) * (1 - np.abs(r))


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def probabilities(raw: np.ndarray, plan: Plan) -> np.ndarray:
    """Class probabilities (or, for regression, the prediction) from summed tree values."""
    if not plan.classes or plan.kind == "rf":
        return raw
    if plan.classes == 2:
        p = 1 / (1 + np.exp(-raw[:, 0]))
        return np.stack([1 - p, p], 1)
    return softmax(raw)


def start(plan: Plan, n: float, s: float, ss: float, per_class: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Bias of the sums, scale of the targets, and what a forest's targets are centred by, from a group's counts and centred sums."""
    if not plan.classes:
        sd = float(np.sqrt(max(ss, 0.0) / n)) if n else 1.0
        return np.array([s / n if n else 0.0]), sd if sd > 0 else 1.0, s / n if n else 0.0
    if plan.kind == "rf":
        return np.zeros(plan.classes), 1.0, 0.0
    share = np.clip(per_class / max(n, 1.0), 1e-12, 1 - 1e-12)
    return (np.array([np.log(share[1] / share[0])]) if plan.classes == 2 else np.log(share)), 1.0, 0.0


def blocks_of(plan: Plan, features: int, width: int) -> list[tuple[int, int]]:
    if plan.kind == "gbt":
        return [(0, plan.trees)]
    if plan.classes and features <= KNOWN_FEATURES:
        features = int(np.sqrt(features))  # a level counts what the nodes look at
    per_tree = min(1 << plan.depth, 4096) * max(features, 1) * width * (plan.outputs + 1)
    size = int(max(1, min(BLOCK_TREES, LEVEL_CELLS // max(per_tree, 1))))
    return [(a, min(size, plan.trees - a)) for a in range(0, plan.trees, size)]


def grown(plan: Plan, x: np.ndarray, y: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], init: tuple[np.ndarray, float, float]) -> list[Grower]:
    """All trees of one group, in memory."""
    return grown_batch(plan, binned(x, cuts), y, h, np.zeros(len(y), np.int64), slots_of(cuts), [init])


def grown_batch(plan: Plan, bins: np.ndarray, y: np.ndarray, h: np.ndarray, group: np.ndarray, slots: np.ndarray,
                inits: Sequence[tuple[np.ndarray, float, float]]) -> list[Grower]:
    """All trees of some groups, in memory; ``slots`` leaves each feature the bins of the group that has most."""
    bins = np.asfortranarray(bins, smallest(bins))
    size, out = plan.trees if plan.kind == "gbt" else int(min(plan.trees, max(1, LIVE_PAIRS // max(len(y), 1)))), []
    for first in range(0, plan.trees, size):
        g = Grower(plan, first, min(size, plan.trees - first))
        g.begin(inits)
        raw, held = g.bias[group], None
        while True:
            node, row, stats = g.live(bins, y, h, raw, group)
            held = held or Live(bins, row, slots)  # boosting takes up all rows in the same order each round
            leaf = g.deepen(held, node, stats)
            if g.done:
                break
            for k, reached in enumerate(leaf.reshape(g.k, len(y))):
                raw[:, k] += g.value[reached, k]
            g.plant()
        out.append(g)
    return out


def models_of(plan: Plan, x: np.ndarray, y: np.ndarray, h: np.ndarray, sizes: np.ndarray, cuts: Sequence[list[np.ndarray]],
              inits: Sequence[tuple[np.ndarray, float, float]]) -> Iterator[tuple[int, dict]]:
    """``(group, model)`` for each block of trees of groups whose rows come one group after the other, grown a batch of groups at a time."""
    ends = np.cumsum(sizes)
    # a forest of a batch has a block of all its trees, boosting has one tree an output at a time
    limit, a = max(1, LIVE_PAIRS // (plan.trees if plan.kind == "rf" else plan.outputs)), 0
    while a < len(sizes):
        b = a + 1
        while b < len(sizes) and ends[b] - (ends[a] - sizes[a]) <= limit:
            b += 1
        mine, group = slice(ends[a] - sizes[a], ends[b - 1]), np.repeat(np.arange(b - a), sizes[a:b])
        slots = slots_of([max(c, key=len) for c in zip(*cuts[a:b])])
        bins = np.concatenate([binned(x[mine][group == k], c) for k, c in enumerate(cuts[a:b])])
        for g in grown_batch(plan, bins, y[mine], h[mine], group, slots, inits[a:b]):
            for k, c in enumerate(cuts[a:b]):
                yield a + k, g.model(c, k)
        a = b


def grid_of(v: np.ndarray, bins: int = BINS) -> np.ndarray:
    """What ``grids`` finds for one feature of a group of up to ``EXACT_ROWS`` rows."""
    few = np.unique(v)
    if len(few) <= bins:
        return few
    at = np.ceil(np.arange(bins + 1) / bins * len(v)).astype(np.int64)
    return np.unique(np.sort(v)[np.maximum(at, 1) - 1])


# ---- fitting over a table ------------------------------------------------------------------------------------

def grids(train: DataFrame, by: Sequence[str], vec: str, bins: int = BINS) -> DataFrame:
    """Values that bins lie around, per group: ``by, grid`` (an array per feature): all distinct values if at most ``bins``, else quantiles."""
    long = train.select(*by, F.posexplode(F.col(vec).cast("array<double>")).alias("_f", "_v"))
    key = [*by, "_f"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_v"))
    few = long.distinct().withColumn("_r", rank).where(F.col("_r") <= bins + 1).groupBy(*key).agg(F.array_sort(F.collect_list("_v")).alias("_few"))
    few = write_once(few, "tree-values")
    beyond = long.join(few.where(F.size("_few") > bins).select(*key), key, "left_semi")  # most features have few values: no sketch of theirs
    many = beyond.groupBy(*key).agg(F.percentile_approx("_v", [i / bins for i in range(bins + 1)], 20 * bins).alias("_q"))
    grid = F.when(F.size("_few") <= bins, F.col("_few")).otherwise(F.array_distinct("_q"))
    one = few.join(many, key, "left").select(*key, grid.alias("_g"))
    return one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_g"))), lambda s: s["_g"]).alias("grid"))


def target_sums(src: DataFrame, by: list[str], classes: int) -> DataFrame:
    """``by, _n, _s, _ss, _per_class``: what ``start`` needs of each group of ``src(by, _y)``."""
    n = F.count(F.lit(1))
    return src.groupBy(*by).agg(n.alias("_n"), (F.avg("_y") * n).alias("_s"), (F.var_pop("_y") * n).alias("_ss"),
                                F.array(*[F.count(F.when(F.col("_y") == c, 1)).cast("double") for c in range(classes)]).cast("array<double>").alias("_per_class"))


def fit_trees(train: DataFrame, by: Sequence[str], key: str, vec: str, y: str, plan: Plan, bins: int = BINS, group_rows: int | None = None) -> DataFrame:
    """One ensemble per group: rows ``by, block, bias, roots, feature, threshold, left, right, value, cover``.

    ``vec`` holds the features (no missing values), ``y`` the target: a number,
    or class 0 .. classes - 1.  Rows without group, vector or target do not
    count; a group without rows has no model.  The nodes of a block are flat
    arrays, ``value`` with ``plan.outputs`` numbers a node; a prediction is the
    bias (of one block) plus the values of the leaves reached.  Groups beyond
    ``group_rows`` rows (by default what ``rows_in_one_task`` says) are grown in chunks.
    """
    by = list(by)
    ship_package(train.sparkSession)
    src = train.select(*by, F.col(key).alias("_key"), F.col(vec).cast("array<double>").alias("_x"), F.col(y).cast("double").alias("_y"))
    src = src.dropna(subset=[*by, "_x", "_y"])
    base = grids(src, by, "_x", bins).join(target_sums(src, by, plan.classes), by).withColumn("_no", F.monotonically_increasing_id())
    most = rows_in_one_task(plan, F.size("grid")) if group_rows is None else F.lit(group_rows)
    base = write_once(base.withColumn("_large", F.col("_n") > most), "tree-grids")
    kinds = dict(src.dtypes)
    names = ", ".join(f"`{b}` {kinds[b]}" for b in by)
    schema = arrow_schema(train, f"{names}, {MODEL}")

    def whole(rows: pa.Table, groups: pa.Table) -> pa.Table:
        """Models of the groups of a lot, a batch of groups at a time."""
        out, found = [], []
        rows = rows.take(pa.array(np.argsort(rows.column("_of").to_numpy(), kind="stable")))
        no, sizes = np.unique(rows.column("_of").to_numpy(), return_counts=True)
        held = {g["_no"]: (k, g) for k, g in enumerate(groups.drop_columns(by).to_pylist())}
        cuts = [[thresholds(v) for v in held[n][1]["grid"]] for n in no]
        inits = [start(plan, g["_n"], g["_s"], g["_ss"], np.array(g["_per_class"])) for g in (held[n][1] for n in no)]
        x = vectors_of(rows) if len(no) else np.zeros((0, 0))
        for k, m in models_of(plan, x, rows.column("_y").to_numpy(), rows.column("_h").to_numpy(), sizes, cuts, inits):
            out.append(held[no[k]][0])
            found.append(m)
        return models_table(groups.take(pa.array(out, pa.int64())).select(by), found, schema)

    facts = base.agg(F.sum(F.when(~F.col("_large"), F.col("_n"))).alias("rows"), F.count(F.when(F.col("_large"), 1)).alias("large")).first()
    # lots of groups, one call of the function each: small beside a task's share, large enough for batches
    lots = max((facts["rows"] or 0) // LOT_ROWS, 16 * train.sparkSession.sparkContext.defaultParallelism)
    small = base.where("not _large").drop("_large").withColumn("_lot", F.pmod(F.xxhash64(*by), F.lit(lots)))
    rows = src.join(small.select(*by, "_no", "_lot"), by).select(F.col("_lot").alias("_own"), F.col("_no").alias("_of"), "_x", "_y", F.xxhash64("_key").alias("_h"))
    local = spread(rows, ["_own"]).groupBy("_own").cogroup(spread(small, ["_lot"]).groupBy("_lot")).applyInArrow(whole, f"{names}, {MODEL}")
    if not facts["large"]:
        return local
    large = base.where("_large").drop("_no", "_large")
    return local.unionByName(fit_chunked(src.join(large.select(*by), by, "left_semi"), large, by, plan, names))


def own_groups(rows: pa.Table, groups: pa.Table, by: Sequence[str]) -> np.ndarray:
    """Which row of ``groups`` each row belongs to by the columns ``by``; -1 for none."""
    code = np.zeros(groups.num_rows + rows.num_rows, np.int64)
    for c in by:
        held = pa.chunked_array([*groups.column(c).chunks, *rows.column(c).chunks], groups.schema.field(c).type).combine_chunks().dictionary_encode()
        code = np.unique(code * max(len(held.dictionary), 1) + held.indices.to_numpy(), return_inverse=True)[1]
    at = np.full(len(code) + 1, -1)
    at[code[:groups.num_rows]] = np.arange(groups.num_rows)
    return at[code[groups.num_rows:]]


def fit_and_use(rows: DataFrame, by: Sequence[str], key: str, vec: str, y: str, held_out: str, plans: Sequence[Plan], use: Callable[[pa.Table, list[list[dict]], dict], dict],
                schema: str, beside: DataFrame | None = None, bins: int = BINS, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The ensembles of ``plans`` (regression) fitted to the rows where ``held_out`` is false, and used in the task that grows them.

    ``use(rows of a group with _x, _y and _out, the blocks of each plan's model, the group's row of beside)`` gives the columns of
    ``schema`` as arrays; they come back after ``by``.  A forest has as many bytes as thousands of rows, so that models of many
    groups are never shuffled nor written.  Groups beyond ``group_rows`` training rows are left out and returned as the second
    table (None if there are none): theirs is ``fit_trees``.
    """
    by = list(by)
    ship_package(rows.sparkSession)
    src = rows.select(*by, F.xxhash64(key).alias("_h"), F.col(vec).cast("array<double>").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(held_out).alias("_out"))
    src = src.dropna(subset=[*by, "_x", "_y", "_out"])
    train = src.where("not _out")
    base = write_once(target_sums(train, by, 0), "tree-groups")
    facts = base.agg(F.sum(F.when(F.col("_n") <= group_rows, F.col("_n"))).alias("rows"), F.count(F.when(F.col("_n") > group_rows, 1)).alias("large"),
                     F.count(F.when((F.col("_n") <= group_rows) & (F.col("_n") > EXACT_ROWS), 1)).alias("middle")).first()
    small = base.where(F.col("_n") <= group_rows)
    if facts["middle"]:
        small = small.join(grids(train.join(small.where(F.col("_n") > EXACT_ROWS).select(*by), by, "left_semi"), by, "_x", bins), by, "left")
    else:
        small = small.withColumn("grid", F.lit(None).cast("array<array<double>>"))
    if beside is not None:
        small = small.join(beside, by, "left")
    kinds = dict(src.dtypes)
    full = ", ".join(f"`{b}` {kinds[b]}" for b in by) + f", {schema}"
    as_out = arrow_schema(rows, full)

    def lot(t: pa.Table, groups: pa.Table) -> pa.Table:
        own = own_groups(t, groups, by)
        order = np.argsort(own, kind="stable")
        order = order[np.searchsorted(own[order], 0):]
        t, own = t.take(pa.array(order)), own[order]
        found, at = [], []
        if len(own):
            x, out = vectors_of(t), t.column("_out").to_numpy()
            ys, h = t.column("_y").to_numpy(), t.column("_h").to_numpy()
            fit = np.flatnonzero(~out)
            no, sizes = np.unique(own[fit], return_counts=True)
            held = groups.drop_columns(by).take(pa.array(no)).to_pylist()
            begin = np.cumsum(sizes) - sizes
            cuts = [[thresholds(v) for v in (g["grid"] or [grid_of(c, bins) for c in x[fit[a:a + n]].T])] for g, a, n in zip(held, begin, sizes)]
            models: list[list[list[dict]]] = [[[] for _ in plans] for _ in no]
            for k, plan in enumerate(plans):
                inits = [start(plan, g["_n"], g["_s"], g["_ss"], np.array(g["_per_class"])) for g in held]
                for g, m in models_of(plan, x[fit], ys[fit], h[fit], sizes, cuts, inits):
                    models[g][k].append(as_arrays(m, plan.outputs))
            for k, g in enumerate(no):
                a, b = np.searchsorted(own, [g, g + 1])
                found.append(use(t.slice(a, b - a), models[k], held[k]))
                at.append(np.full(len(next(iter(found[-1].values()))), g))
                models[k] = []
        if not found:
            return as_out.empty_table()
        keys = groups.select(by).take(pa.array(np.concatenate(at)))
        cols = {c: pa.chunked_array([m[c] for m in found]) for c in found[0]}
        return pa.table([keys.column(n) if n in by else cols[n] for n in as_out.names], names=as_out.names).cast(as_out)

    # lots of groups, one call of the function each: small beside a task's share, large enough for batches
    lots = F.lit(max((facts["rows"] or 0) // LOT_ROWS, 16 * rows.sparkSession.sparkContext.defaultParallelism))
    large = base.where(F.col("_n") > group_rows).select(*by) if facts["large"] else None
    if large is not None:
        src = src.join(large, by, "left_anti")
    mine = lambda df: spread(df.withColumn("_lot", F.pmod(F.xxhash64(*by), lots)), ["_lot"]).groupBy("_lot")
    return mine(src).cogroup(mine(small)).applyInArrow(lot, full), large


def rows_in_one_task(plan: Plan, features: Column) -> Column:
    """Rows up to which a group of so many features is grown in one task."""
    if plan.kind == "rf":
        return F.lit(GROUP_ROWS)
    return F.greatest(F.lit(GROUP_ROWS), F.least(F.lit(BOOST_ROWS), F.floor(F.lit(BOOST_NUMBERS) / F.greatest(features * plan.outputs, F.lit(1))).cast("int")))


def vectors_of(t: pa.Table, name: str = "_x") -> np.ndarray:
    """The arrays of a column as a matrix; they have one length."""
    return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def models_table(keys: pa.Table, found: list[dict], schema: pa.Schema) -> pa.Table:
    """Rows of ``MODEL`` from the arrays of each, without a Python object per node."""
    cols = {}
    for f in schema:
        if f.name in keys.column_names:
            cols[f.name] = keys.column(f.name).cast(f.type)
        elif pa.types.is_list(f.type):
            ends = np.cumsum([0, *[len(m[f.name]) for m in found]]).astype(np.int32)
            flat = np.concatenate([m[f.name] for m in found]) if found else np.zeros(0)
            cols[f.name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(f.type.value_type))
        else:
            cols[f.name] = pa.array([m[f.name] for m in found], f.type)
    return pa.table(cols).cast(schema)


def fit_chunked(src: DataFrame, base: DataFrame, by: list[str], plan: Plan, names: str) -> DataFrame:
    """``fit_trees`` for groups of any size: one histogram sum per level over all groups, trees, nodes, features and bins.

    Boosting keeps the sums of the trees so far beside the rows of a chunk
    (``raw``, of the rounds before ``since``), brought up to date every few
    rounds: a level does not run its rows through all trees again.  Its trees
    are few and shallow and are broadcast; those of a forest, megabytes a
    group, meet the chunks in a shuffle that never passes through the driver.
    """
    looks = plan.kind == "rf" and bool(plan.classes)
    rows = base.agg(F.sum("_n")).first()[0]
    chunk_rows = min(max(rows // (4 * src.sparkSession.sparkContext.defaultParallelism), CHUNK_ROWS), FOREST_CHUNK_ROWS) if looks else CHUNK_ROWS
    chunks = packed(src, by, "_x", "_y", "_key", chunk_rows).withColumns({"raw": F.lit(None).cast("binary"), "since": F.lit(0), "chunk": F.monotonically_increasing_id()})
    chunk_schema = f"{names}, n int, x binary, y binary, h binary, raw binary, since int, chunk bigint"
    chunks = write_once(chunks, "tree-chunks")
    places = chunks.select(*by, "chunk")  # a row per chunk
    as_chunk = arrow_schema(src, chunk_schema)
    state_schema, model_schema = f"{names}, block int, grid array<array<double>>, {STATE}", f"{names}, {MODEL}"
    as_state, as_model = arrow_schema(src, state_schema), arrow_schema(src, model_schema)

    def begin(r: dict) -> list[dict]:
        cuts = [thresholds(v) for v in r["grid"]]
        out = []
        init = start(plan, r["_n"], r["_s"], r["_ss"], np.array(r["_per_class"]))
        for first, count in blocks_of(plan, len(cuts), max((len(c) for c in cuts), default=0) + 1):
            g = Grower(plan, first, count)
            g.begin([init])
            out.append({**{b: r[b] for b in by}, "block": first, "grid": r["grid"], **g.state()})
        return out

    n_stats = plan.outputs + 1 if plan.kind == "rf" else 3
    cell_schema = f"{names}, block int, cell bigint, " + ", ".join(f"s{s} double" for s in range(n_stats))
    as_cells = arrow_schema(src, cell_schema)

    def so_far(r: dict, g: Grower, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
        bins = binned(np.frombuffer(r["x"], "<f8").reshape(r["n"], -1), cuts)
        if plan.kind == "rf":
            return bins, None
        return bins, g.raw(bins, None if r["raw"] is None else np.frombuffer(r["raw"], "<f8").reshape(r["n"], -1), r["since"])

    def renew(r: dict) -> list[dict]:
        g = Grower.of(plan, r)
        raw = so_far(r, g, [thresholds(v) for v in r["grid"]])[1]
        return [{**{c: r[c] for c in as_chunk.names}, "raw": raw.astype("<f8").tobytes(), "since": g.rounds - 1}]

    def held(v: pa.Scalar):
        """A value, the array of a flat list: a chunk's copy of the trees makes no Python object per node."""
        return v.values.to_numpy(zero_copy_only=False) if pa.types.is_list(v.type) and v.is_valid and pa.types.is_primitive(v.type.value_type) else v.as_py()

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Non-empty histogram cells of each (chunk, block of trees); the blocks of a chunk come one after the other and share its bins."""
        last: dict = {}
        for part in parts:
            for k in range(part.num_rows):
                r = {n: held(part.column(n)[k]) for n in part.schema.names}
                r = {**{c: np.zeros(len(r["feature"]) * (plan.outputs if c == "value" else 1)) for c in UNROUTED}, **r}
                g, cuts = Grower.of(plan, r), [thresholds(v) for v in r["grid"]]
                if plan.kind == "rf" and last and last["chunk"] == r["chunk"]:
                    bins, raw = last["bins"], None
                else:
                    bins, raw = so_far(r, g, cuts)
                    bins = np.asfortranarray(bins, smallest(bins))
                    last = {"chunk": r["chunk"], "bins": bins}
                y, h = np.frombuffer(r["y"], "<f8"), np.frombuffer(r["h"], "<i8")
                if looks and len(cuts) <= KNOWN_FEATURES:
                    cell, sums = g.class_cells(bins, slots_of(cuts), y, h)
                else:
                    node, row, stats = g.live(bins, y, h, raw)
                    node = g.route(bins, node, row)
                    keep = np.flatnonzero(g.node["open"][node])
                    cell, sums = g.cells(bins, slots_of(cuts), (node[keep], row[keep], [v[keep] for v in stats]))
                if len(cell):
                    own = {b: pa.array([r[b]], as_cells.field(b).type).take(pa.array(np.zeros(len(cell), np.int64))) for b in by}
                    block = pa.array(np.full(len(cell), r["block"], np.int32))
                    yield pa.RecordBatch.from_arrays([*own.values(), block, pa.array(cell.astype(np.int64)), *[pa.array(v) for v in sums]], schema=as_cells)

    def pick(sums: pa.Table, held: pa.Table) -> pa.Table:
        r = held.to_pylist()[0]
        g, slots = Grower.of(plan, r), slots_of([thresholds(v) for v in r["grid"]])
        sums = sums.sort_by("cell")
        g.level(sums.column("cell").to_numpy(), [sums.column(f"s{s}").to_numpy().astype(float) for s in range(n_stats)], slots, looks and len(r["grid"]) <= KNOWN_FEATURES)
        if not g.node["open"].any() and not g.done:
            g.plant()
        return pa.Table.from_pylist([{**{b: r[b] for b in by}, "block": r["block"], "grid": r["grid"], **g.state()}], schema=as_state)

    def met(growing: DataFrame) -> DataFrame:
        """Each chunk with the open blocks of its group, one after the other."""
        copies = growing.drop(*UNROUTED).join(F.broadcast(places), by).drop(*by)
        return spread(chunks, ["chunk"]).join(spread(copies, ["chunk"]).hint("merge"), "chunk")

    state = write_once(base.mapInArrow(each_row(begin, as_state), state_schema), "tree-state")
    keys = [*by, "block"]
    is_open = F.exists("open", lambda o: o == 1)
    boosts = plan.kind == "gbt"
    level = 0
    while True:
        growing = state.where(is_open)
        # a level of nothing does no harm: boosting, of many short levels, does not ask each time
        if level % (2 * plan.depth if boosts else 1) == 0 and growing.isEmpty():
            break
        if boosts and level and level % (RENEW_ROUNDS * plan.depth) == 0:
            chunks = write_once(chunks.join(F.broadcast(growing), by).mapInArrow(each_row(renew, as_chunk), chunk_schema), "tree-chunks")
        found = (chunks.join(F.broadcast(growing), by) if boosts else met(growing)).mapInArrow(count, cell_schema)
        sums = found.groupBy(*keys, "cell").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(n_stats)])
        picked = sums.groupBy(*keys).cogroup(growing.groupBy(*keys)).applyInArrow(pick, state_schema)
        state = write_once(picked.unionByName(state.where(~is_open)), "tree-state")
        level += 1

    def close(r: dict) -> list[dict]:
        return [{**{b: r[b] for b in by}, **{k: v if np.isscalar(v) else v.tolist() for k, v in Grower.of(plan, r).model([thresholds(v) for v in r["grid"]]).items()}}]

    return state.mapInArrow(each_row(close, as_model), model_schema)


def arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


# ---- using the models -----------------------------------------------------------------------------------------

def leaves(model: dict, x: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Leaf of each row in the trees at ``roots``, ``(tree, row)``."""
    feature, threshold, n = model["feature"], model["threshold"], len(x)
    ends, flat = feature < 0, np.ascontiguousarray(x.T).ravel()
    own = np.arange(len(feature))  # a leaf keeps its rows
    kids = np.stack([np.where(ends, own, model["right"]), np.where(ends, own, model["left"])], 1).ravel()
    begin = np.where(ends, 0, feature) * n
    at, row = np.repeat(roots, n), np.tile(np.arange(n), len(roots))
    while n and not ends.take(at).all():
        at = kids.take(2 * at + (flat.take(begin.take(at) + row) <= threshold.take(at)))
    return at.reshape(len(roots), n)


def as_arrays(m: dict, outputs: int) -> dict:
    out = {k: np.asarray(m[k], np.int64) for k in ("roots", "feature", "left", "right")}
    return {**out, "threshold": np.asarray(m["threshold"], float), "cover": np.asarray(m["cover"], float), "bias": np.asarray(m["bias"], float),
            "value": np.asarray(m["value"], float).reshape(-1, outputs)}


def held_models(t: pa.Table, outputs: int) -> list[dict]:
    """The rows of a table of ``MODEL`` as arrays, by block."""
    t = t.sort_by("block").select(["bias", "roots", "feature", "threshold", "left", "right", "value", "cover"])
    return [as_arrays({n: t.column(n)[k].values.to_numpy(zero_copy_only=False) for n in t.column_names}, outputs) for k in range(t.num_rows)]


def joined(models: list[dict]) -> list[dict]:
    """The blocks of a model as one: all trees, nodes renumbered; the bias is the same in each."""
    at = np.cumsum([0, *[len(m["feature"]) for m in models]])
    shift = lambda v, a: np.where(v >= 0, v + a, v)
    one = {k: np.concatenate([m[k] for m in models]) for k in ("feature", "threshold", "value", "cover")}
    return [{**one, "bias": models[0]["bias"], **{k: np.concatenate([shift(m[k], a) for m, a in zip(models, at)]) for k in ("roots", "left", "right")}}]


def summed(models: list[dict], x: np.ndarray) -> np.ndarray:
    """Bias plus leaf values of all trees, ``(rows, outputs)``."""
    out = np.tile(models[0]["bias"], (len(x), 1))
    size = max(1, LIVE_PAIRS // max(len(x), 1))
    for m in models:
        for a in range(0, len(m["roots"]), size):
            for reached in leaves(m, x, m["roots"][a:a + size]):
                out += m["value"][reached]
    return out


def predict(rows: DataFrame, models: DataFrame, by: Sequence[str], key: str, vec: str, plan: Plan, out: str = "prediction", keep: Sequence[str] = ()) -> DataFrame:
    """``by, key, keep, <out>`` array<double>: class probabilities, or for regression one number; rows of groups without a model are left out."""
    by = list(by)
    kinds = dict(rows.dtypes)
    names = [*by, key, *keep]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{out}` array<double>"

    def one(t: pa.Table, m: pa.Table) -> pa.Table:
        got = probabilities(summed(held_models(m, plan.outputs), vectors_of(t)), plan) if t.num_rows and m.num_rows else np.zeros((0, 1))
        t = t.slice(0, len(got))
        ends = pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1])
        return pa.table({**{c: t.column(c) for c in names}, out: pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(got).ravel()))})

    src = rows.select(*names, F.col(vec).cast("array<double>").alias("_x")).where(F.col("_x").isNotNull())
    return apply_models(src, models, by, key, one, schema)


def leaf_paths(m: dict, x: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per leaf of a tree the features of its path in slots: ``(leaf, feature (leaves, slots), zero (leaves, slots), one (leaves, slots, rows))``.

    ``one`` says whether a row follows the path at all splits on the feature,
    ``zero`` is the product of the cover shares there; unused slots have
    feature -1 and 1 for both, a player that changes nothing.
    """
    feature, threshold, left, right, cover = (m[k] for k in ("feature", "threshold", "left", "right", "cover"))
    found: list[tuple[int, dict[int, tuple[np.ndarray, float]]]] = []
    todo: list[tuple[int, dict[int, tuple[np.ndarray, float]]]] = [(int(root), {})]
    while todo:
        node, path = todo.pop()
        f = int(feature[node])
        if f < 0:
            found.append((node, path))
            continue
        goes = x[:, f] <= threshold[node]
        one, zero = path.get(f, (None, 1.0))
        for kid, mine in ((int(left[node]), goes), (int(right[node]), ~goes)):
            todo.append((kid, {**path, f: (mine if one is None else one & mine, zero * cover[kid] / cover[node])}))
    slots = max(len(p) for _, p in found)
    feat, zero, one = np.full((len(found), slots), -1), np.ones((len(found), slots)), np.ones((len(found), slots, len(x)))
    for k, (_, path) in enumerate(found):
        for s, (f, (o, z)) in enumerate(path.items()):
            feat[k, s], zero[k, s], one[k, s] = f, z, o
    return np.array([node for node, _ in found]), feat, zero, one


def tree_attribution(m: dict, x: np.ndarray, root: int) -> np.ndarray:
    """Path-dependent attributions ``(rows, features, outputs)`` of one tree: Shapley values of the game in which a split on an unknown
    feature sends a row down both sides in proportion to their cover.

    Each leaf is a product game over the features of its path: feature j is
    worth ``one_j`` when known and ``zero_j`` when not.  The subset weights are
    extended by one feature at a time, for all leaves and rows at once; for a
    feature's own share they are unwound by it again.
    """
    leaf, feat, zero, one = leaf_paths(m, x, root)
    value, d = m["value"][leaf], feat.shape[1]
    phi = np.zeros((len(x), x.shape[1], value.shape[1]))
    weight = np.zeros((d + 1, len(leaf), len(x)))  # by number of known features, Shapley weights included
    weight[0] = 1.0
    for j in range(d):
        for i in range(j, -1, -1):
            weight[i + 1] += one[:, j] * weight[i] * ((i + 1) / (j + 2))
            weight[i] *= zero[:, j, None] * ((j + 1 - i) / (j + 2))
    for j in range(d):
        z, known = zero[:, j, None], one[:, j] > 0
        follow, leave = np.zeros_like(weight[0]), np.zeros_like(weight[0])
        after = weight[d]
        for i in range(d - 1, -1, -1):
            own = after * ((d + 1) / (i + 1))  # rows that follow the path: from the top
            follow += own
            after = weight[i] - own * z * ((d - i) / (d + 1))
            leave += weight[i] * ((d + 1) / (d - i))  # the others: known it is worth nothing, so only the unknown part is unwound
        share = np.where(known, follow * (1 - z), -leave)  # leave / z times (0 - z)
        for f in np.unique(feat[:, j]):
            if f >= 0:
                at = feat[:, j] == f
                phi[:, f] += share[at].T @ value[at]
    return phi


def boxes(m: dict, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of all trees: ``(leaf, low, high, zero)`` with the bins ``low <= bin < high`` of each feature and the product of the cover
    shares of its splits, 1 where the path has none."""
    n = len(cuts)
    at = m["roots"]
    low, high, zero = np.zeros((len(at), n), np.int64), np.tile([len(c) + 1 for c in cuts], (len(at), 1)), np.ones((len(at), n))
    tick = np.zeros(len(m["feature"]), np.int64)
    for f, c in enumerate(cuts):
        own = m["feature"] == f
        tick[own] = np.searchsorted(c, m["threshold"][own], "left") + 1
    found = []
    while len(at):
        f = m["feature"][at]
        end, go = np.flatnonzero(f < 0), np.flatnonzero(f >= 0)
        found.append((at[end], low[end], high[end], zero[end]))
        parts, i = [], np.arange(len(go))
        f, node = f[go], at[go]
        for side in ("left", "right"):
            kid, a, b, z = m[side][node], low[go], high[go], zero[go]
            z[i, f] *= m["cover"][kid] / m["cover"][node]
            if side == "left":
                b[i, f] = np.minimum(b[i, f], tick[node])
            else:
                a[i, f] = np.maximum(a[i, f], tick[node])
            parts.append((kid, a, b, z))
        at, low, high, zero = (np.concatenate(v) for v in zip(*parts))
    return tuple(np.concatenate(v) for v in zip(*found))


#: Cells of the largest table of expected values that attributions are read from, and features at most.
GRID_CELLS, GRID_FEATURES = 500_000, 6


def grid_attributions(m: dict, x: np.ndarray) -> np.ndarray | None:
    """``attributions`` of one model from tables of expected values; None where the tables would be too large.

    With the features S known, a leaf is worth its value times the cover
    shares of the others inside its box and nothing outside: for all leaves of
    all trees together that is a table over the bins of S, which corners of
    the boxes and running sums fill.  Shapley's weights add up its reads.
    """
    n, outputs = x.shape[1], m["value"].shape[1]
    cuts = [np.unique(m["threshold"][m["feature"] == f]) for f in range(n)]
    used = [f for f in range(n) if len(cuts[f])]
    sizes = np.array([len(c) + 2 for c in cuts])  # one more, where boxes end
    if len(used) > GRID_FEATURES or np.prod(sizes[used].astype(float)) > GRID_CELLS:
        return None
    leaf, low, high, zero = boxes(m, cuts)
    value, bins = m["value"][leaf], binned(x, cuts)
    expected = {}
    for mask in range(1 << len(used)):
        known = [f for i, f in enumerate(used) if mask >> i & 1]
        rest = [f for i, f in enumerate(used) if not mask >> i & 1]
        worth = value * zero[:, rest].prod(1)[:, None]
        if not known:
            expected[mask] = np.tile(worth.sum(0), (len(x), 1))
            continue
        shape = tuple(sizes[known])
        cell, sign = np.zeros((1, len(leaf)), np.int64), np.ones(1)
        for f in known:
            cell = np.concatenate([cell * sizes[f] + low[:, f], cell * sizes[f] + high[:, f]])
            sign = np.concatenate([sign, -sign])
        read = np.ravel_multi_index(tuple(bins[:, f] for f in known), shape)
        got = []
        for o in range(outputs):
            table = np.bincount(cell.ravel(), (sign[:, None] * worth[:, o]).ravel(), int(np.prod(shape))).reshape(shape)
            for axis in range(len(known)):
                np.cumsum(table, axis, out=table)
            got.append(table.ravel()[read])
        expected[mask] = np.stack(got, 1)
    phi, d = np.zeros((*x.shape, outputs)), len(used)
    for i, f in enumerate(used):
        for mask in (s for s in range(1 << d) if not s >> i & 1):
            k = mask.bit_count()
            phi[:, f] += (expected[mask | 1 << i] - expected[mask]) * (math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d))
    return phi


def attributions(models: list[dict], x: np.ndarray) -> np.ndarray:
    """Attributions of the summed tree values, ``(rows, features, outputs)``; per row they add up to the sum less its mean over the cover."""
    out = np.zeros((*x.shape, models[0]["value"].shape[1]))
    for m in models:
        phi = grid_attributions(m, x)
        out += sum((tree_attribution(m, x, root) for root in m["roots"]), np.zeros(out.shape)) if phi is None else phi
    return out


def tree_importance(rows: DataFrame, models: DataFrame, by: Sequence[str], key: str, vec: str, names: Sequence[str], plan: Plan, chunk_rows: int = EXPLAIN_ROWS) -> DataFrame:
    """K12 (trees): mean absolute attribution of each feature per group, ``by, feature, importance`` (summed over outputs)."""
    by = list(by)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", sums array<double>, n bigint"

    def one(t: pa.Table, m: pa.Table) -> pa.Table:
        cols: dict = {b: t.column(b).slice(0, 1) for b in by}
        if not t.num_rows or not m.num_rows:
            return pa.table({**{b: c.slice(0, 0) for b, c in cols.items()}, "sums": pa.array([], pa.list_(pa.float64())), "n": pa.array([], pa.int64())})
        phi = attributions(joined(held_models(m, plan.outputs)), vectors_of(t))
        return pa.table({**cols, "sums": pa.array([np.abs(phi).sum(2).sum(0)], pa.list_(pa.float64())), "n": pa.array([t.num_rows], pa.int64())})

    src = rows.select(*by, key, F.col(vec).cast("array<double>").alias("_x")).where(F.col("_x").isNotNull())
    parts = apply_models(src, models, by, key, one, schema, chunk_rows)
    tall = parts.select(*by, "n", F.posexplode("sums").alias("_f", "_s"))
    mean = tall.groupBy(*by, "_f").agg((F.sum("_s") / F.sum("n")).alias("importance"))
    return mean.select(*by, F.array(*[F.lit(x) for x in names])[F.col("_f")].alias("feature"), "importance")
