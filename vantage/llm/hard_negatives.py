"""Hard-negative mining with segment summaries.

Vectors become integers, ``floor(scale * x)``, and scores are their exact
integer inner products.  For every vector the means and deviations of its
segments are stored, at several levels: the whole vector, quarters,
sixteenths.  Within a segment of length l the inner product of x and a is
``l mean(x) mean(a)`` plus or minus at most ``l dev(x) dev(a)`` (Cauchy and
Schwarz on what is left after the means), so summed over a level's segments
these bound the score from both sides.  A pair that the coarse level cannot
rule out goes to the next finer one, and what passes all levels is scored
exactly.

Two searches use that filter, each of the stated anchors against all rows:
the best rows of the anchor's label (its positives), for which only an upper
bound above the current k-th best counts, and for each positive the best rows
of other labels whose score lies within a band of the positive's, for which the
lower bound must not pass the band's top either.  Rows stay where they are:
each task keeps the current best of every anchor of the block it was sent and
returns those; anchors are taken in blocks of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import bound_batches, col, materialise

POSITIVES, NEGATIVES, BAND, SCALE = 5, 10, (30, 90), 256
#: Segments of each level, coarse to fine; levels with segments shorter than two numbers are left out.
LEVELS = (1, 4, 16)
#: Bytes of anchors in one pass over the rows; rows compared at once; anchors compared at once.
BLOCK_BYTES, TILE_ROWS, CHUNK = 16 << 20, 2048, 512
#: Share of a submatrix above which the next step takes it whole rather than pair by pair.
_DENSE = 0.05
_NULL_ID = (1 << 63) - 1


@lru_cache(maxsize=64)
def cuts(dim: int) -> list[np.ndarray]:
    """Segment borders of each level; those of a level are among those of the next."""
    return [np.array([dim * i // n for i in range(n + 1)]) for n in LEVELS if n == 1 or dim >= 2 * n]


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all levels' segments of the rows of ``x``, side by side."""
    means, devs = [], []
    for c in cuts(x.shape[1]):
        size = np.diff(c)
        mean = np.add.reduceat(x, c[:-1], axis=1) / size if x.shape[1] else np.zeros((len(x), 1))
        rest = x - np.repeat(mean, size, axis=1)
        means.append(mean)
        devs.append(np.sqrt(np.add.reduceat(rest * rest, c[:-1], axis=1) / size) if x.shape[1] else np.zeros((len(x), 1)))
    return np.hstack(means), np.hstack(devs)


class Vectors:
    """Integer vectors of one length with their ids, labels and summaries, the latter times the root of the segment length."""

    def __init__(self, rid: np.ndarray, ids: np.ndarray, label: np.ndarray, x: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> None:
        self.rid, self.ids, self.label, self.x = rid, ids, label, x
        root = np.sqrt(np.concatenate([np.diff(c) for c in cuts(x.shape[1])]))
        ends = np.cumsum([0, *(len(c) - 1 for c in cuts(x.shape[1]))])
        self.levels = [((mean * root)[:, a:b], (dev * root)[:, a:b]) for a, b in zip(ends, ends[1:])]
        self.largest = np.abs(x).max() if x.size else 0

    def take(self, at) -> Vectors:
        new = object.__new__(Vectors)
        new.rid, new.ids, new.label, new.x, new.largest = self.rid[at], self.ids[at], self.label[at], self.x[at], self.largest
        new.levels = [(m[at], d[at]) for m, d in self.levels]
        return new


def products(x: np.ndarray, a: np.ndarray, small: bool) -> np.ndarray:
    """Exact inner products of all rows; in floating point where every partial sum is below 2^53."""
    return (x.astype(np.float64) @ a.astype(np.float64).T).astype(np.int64) if small else x @ a.T


def within(rows: Vectors, anchors: Vectors, ok: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Pairs of ``ok`` whose score is at least ``low`` and at most ``high`` of the anchor: ``(row, anchor, score)`` and the pairs left after each level."""
    left = []
    for (xm, xd), (am, ad) in zip(rows.levels, anchors.levels):
        r, c = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        n = int(ok.sum())
        if n == 0:
            break
        if n > _DENSE * len(r) * len(c):
            mid, dev = xm[r] @ am[c].T, xd[r] @ ad[c].T
            slack = 1e-6 + 1e-9 * (np.abs(mid) + dev)
            ok[np.ix_(r, c)] &= (mid + dev + slack >= low[c]) & (mid - dev - slack <= high[c])
        else:
            i, j = np.nonzero(ok)
            mid, dev = (xm[i] * am[j]).sum(1), (xd[i] * ad[j]).sum(1)
            slack = 1e-6 + 1e-9 * (np.abs(mid) + dev)
            ok[i, j] = (mid + dev + slack >= low[j]) & (mid - dev - slack <= high[j])
        left.append(int(ok.sum()))
    i, j = np.nonzero(ok)
    if not len(i):
        return i, j, np.zeros(0, np.int64), left
    small = float(rows.largest) * float(anchors.largest) * rows.x.shape[1] < 2.0**53
    r, c = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    if len(i) > _DENSE * len(r) * len(c):
        at_r, at_c = np.zeros(ok.shape[0], np.int64), np.zeros(ok.shape[1], np.int64)
        at_r[r], at_c[c] = np.arange(len(r)), np.arange(len(c))
        score = products(rows.x[r], anchors.x[c], small)[at_r[i], at_c[j]]
    else:
        score = (rows.x[i] * anchors.x[j]).sum(1)
    good = (score >= low[j]) & (score <= high[j])
    return i[good], j[good], score[good], left


def first(score: np.ndarray, ids: np.ndarray, rid: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rid, ids, -score))[:k]


class Best:
    """The best ``k`` (score, id, rid) of each of ``n`` searches."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.rows = k, [(np.zeros(0, np.int64),) * 3 for _ in range(n)]
        self.floor = np.full(n, -np.inf)

    def add(self, at: int, score: np.ndarray, ids: np.ndarray, rid: np.ndarray) -> None:
        s, i, r = (np.concatenate(x) for x in zip(self.rows[at], (score, ids, rid)))
        keep = first(s, i, r, self.k)
        self.rows[at] = s[keep], i[keep], r[keep]
        if len(keep) == self.k:
            self.floor[at] = s[keep[-1]]

    def batch(self, names: dict[str, np.ndarray]) -> pa.RecordBatch:
        size = np.array([len(s) for s, _, _ in self.rows], np.int64)
        cat = [np.concatenate([r[k] for r in self.rows]) if self.rows else np.zeros(0, np.int64) for k in range(3)]
        return pa.RecordBatch.from_pydict({**{k: np.repeat(v, size) for k, v in names.items()}, "score": cat[0], "id": cat[1], "rid": cat[2]})


def tiles(parts: Iterator[pa.RecordBatch]) -> Iterator[Vectors]:
    """Stored rows as tiles of vectors of one length."""
    for part in parts:
        yield from stored(pa.Table.from_batches([part]), TILE_ROWS)


def stored(t: pa.Table, rows: int | None = None) -> Iterator[Vectors]:
    dims = t.column("dim").to_numpy()
    for dim in np.unique(dims):
        own = t.filter(pa.array(dims == dim))
        step = rows or max(1, own.num_rows)
        for at in range(0, own.num_rows, step):
            s = own.slice(at, step)
            flat = lambda c: s.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(s.num_rows, -1)
            x = flat("x") if dim else np.zeros((s.num_rows, 0), np.int64)
            ids = s.column("id").combine_chunks().fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            yield Vectors(s.column("rid").to_numpy(), ids, s.column("label").to_numpy(), x, flat("mean"), flat("dev"))


def prepare(df: DataFrame, scale: int) -> DataFrame:
    """``df(id, label, vec, is_anchor)`` -> integer vectors with a row number and their stored summaries."""

    def summarise(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vec = part.column("vec")
            dims = pa.compute.list_value_length(vec).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = part.filter(pa.array(dims == dim))
                n, d = own.num_rows, int(dim)
                x = np.floor(scale * own.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, d))
                fits = (np.abs(x) <= np.sqrt((2.0**63 - 1) / max(d, 1)) * (1 - 1e-9)).all(1)
                own, x = own.filter(pa.array(fits)), x[fits].astype(np.int64)
                mean, dev = summaries(x.astype(np.float64))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel())) for v in (x, mean, dev)]
                yield pa.RecordBatch.from_arrays([own.column("rid"), own.column("id"), own.column("label"), own.column("is_anchor"), pa.array(np.full(len(x), d, np.int32)), *lists],
                                                 names=["rid", "id", "label", "is_anchor", "dim", "x", "mean", "dev"])

    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fit = df.where(F.col("label").isNotNull() & F.col("vec").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    fit = fit.select(F.monotonically_increasing_id().alias("rid"), "id", "label", "vec", "is_anchor")
    return fit.mapInArrow(summarise, "rid bigint, id bigint, label bigint, is_anchor boolean, dim int, x array<bigint>, mean array<double>, dev array<double>")


def positives(rows: DataFrame, blocks: list[Vectors], k: int) -> DataFrame:
    """The best ``k`` other rows of its label for each anchor of the block: ``(anchor, rank, id, rid, score)``."""
    label = lambda v: {x: np.flatnonzero(v.label == x) for x in np.unique(v.label)}

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {a.x.shape[1]: (a, label(a), Best(len(a.rid), k)) for a in blocks}
        for tile in tiles(parts):
            if tile.x.shape[1] not in best:
                continue
            a, by_label, kept = best[tile.x.shape[1]]
            for x, at in label(tile).items():
                for c in range(0, len(by_label.get(x, ())), CHUNK):
                    own = by_label[x][c:c + CHUNK]
                    part, some = tile.take(at), a.take(own)
                    ok = part.rid[:, None] != some.rid[None, :]
                    i, j, score, _ = within(part, some, ok, kept.floor[own], np.full(len(own), np.inf))
                    for n, s, e in runs(j):
                        kept.add(own[n], score[s][e], part.ids[i[s]][e], part.rid[i[s]][e])
        for a, _, kept in best.values():
            yield kept.batch({"anchor": a.rid})

    found = rows.mapInArrow(search, "anchor bigint, score bigint, id bigint, rid bigint")
    return ranked(found, ["anchor"], k)


def runs(j: np.ndarray) -> Iterator[tuple[int, np.ndarray, slice]]:
    """Positions of each value of ``j``."""
    order = np.argsort(j, kind="stable")
    edges = np.flatnonzero(np.diff(j[order])) + 1
    for group in np.split(order, edges) if len(j) else ():
        yield int(j[group[0]]), group, slice(None)


def negatives(rows: DataFrame, blocks: list[tuple[Vectors, np.ndarray, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """For each search (an anchor's row in the block, a lowest and a highest score) the best ``k`` rows of other labels: ``(search, rank, id, rid, score)``.

    ``blocks`` holds, per vector length, the anchors, the searches of anchor a
    at ``[start[a], start[a + 1])``, and their lowest and highest scores.
    """

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {b[0].x.shape[1]: (*b, Best(len(b[2]), k)) for b in blocks}
        for tile in tiles(parts):
            if tile.x.shape[1] not in best:
                continue
            a, start, low, high, kept = best[tile.x.shape[1]]
            for c in range(0, len(a.rid), CHUNK):
                end = min(len(a.rid), c + CHUNK)
                some = a.take(slice(c, end))
                need = np.maximum(low, kept.floor)
                open_ = np.where(need <= high, need, np.inf)  # a search that nothing can improve asks for nothing
                least = np.minimum.reduceat(np.append(open_, np.inf), start[c:end])
                least[start[c:end] == start[c + 1:end + 1]] = np.inf
                most = np.maximum.reduceat(np.append(high, -np.inf), start[c:end])
                ok = (tile.label[:, None] != some.label[None, :]) & (least <= most)[None, :]
                i, j, score, _ = within(tile, some, ok, least, most)
                for n, at, _ in runs(j):
                    order = at[np.lexsort((tile.rid[i[at]], tile.ids[i[at]], -score[at]))]
                    down = -score[order]
                    for s in range(start[c + n], start[c + n + 1]):
                        top = np.searchsorted(down, -high[s], "left")
                        pick = order[top:np.searchsorted(down, -max(low[s], kept.floor[s]), "right")][:k]
                        if len(pick):
                            kept.add(s, score[pick], tile.ids[i[pick]], tile.rid[i[pick]])
        base = 0
        for a, start, low, _, kept in best.values():
            yield kept.batch({"search": base + np.arange(len(low))})
            base += len(low)

    return ranked(rows.mapInArrow(search, "search bigint, score bigint, id bigint, rid bigint"), ["search"], k)


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` of each group, ranked; first within salted parts."""
    order = [F.col("score").desc(), F.col("id"), F.col("rid")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(32)))
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "salt").orderBy(*order))).where(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k).drop("salt")


def hard_negatives(df: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", n_positives: int = POSITIVES,
                   n_negatives: int = NEGATIVES, band: tuple[int, int] = BAND, scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hard negatives of each anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` says of a row of ``df`` whether it is an anchor.  An anchor's
    positives are its ``n_positives`` best other rows of its label; a negative
    of another label must score between ``band`` per cent of the positive's
    score (none does if that score is negative).  Equal scores go by id, a
    null id last (so an id of 2^63 - 1 counts and returns as null).  Rows
    without label or vector, with null or non-finite numbers, or with numbers
    so large that a score need not fit a long, take no part.  Vectors of
    different length are not compared.  Repeated rows are rows of their own.
    An empty table, or one without anchors, gives no rows; other columns are
    ignored.
    """
    spark = df.sparkSession
    bound_batches(spark)
    src = df.select(col(id_col).cast("bigint").alias("id"), col(label_col).cast("bigint").alias("label"),
                    col(vec_col).cast("array<double>").alias("vec"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    rows = materialise(prepare(src, scale), "negative-rows")
    asked = rows.where("is_anchor")
    size = asked.agg(F.sum(F.size("x") * F.lit(8) + (F.size("mean") + F.size("dev")) * F.lit(8) + 32)).first()[0] or 0
    n_blocks, out = -(-size // block_bytes), []
    for block in range(n_blocks):
        own = list(stored(asked.where(F.pmod(F.xxhash64("rid"), F.lit(n_blocks)) == block).toArrow()))  # about block_bytes
        pos = positives(rows, own, n_positives).select("anchor", "rank", "id", "score").toPandas()  # n_positives rows an anchor at most
        pos = pos.sort_values(["anchor", "rank"])
        blocks, searches, base = [], [], 0
        for a in own:
            at = {r: i for i, r in enumerate(a.rid)}
            mine = pos[pos["anchor"].isin(at)]
            row = mine["anchor"].map(at).to_numpy(np.int64)
            order = np.argsort(row, kind="stable")
            mine, row = mine.iloc[order], row[order]
            score = mine["score"].to_numpy(np.int64)
            low = np.array([-(-band[0] * int(s) // 100) for s in score], np.int64)
            high = np.array([band[1] * int(s) // 100 for s in score], np.int64)
            start = np.searchsorted(row, np.arange(len(a.rid) + 1))
            blocks.append((a, start, low, high))
            searches += [(base + n, int(a.ids[r]), int(p), int(s)) for n, (r, p, s) in enumerate(zip(row, mine["id"], score))]
            base += len(mine)
        if not searches:
            continue
        found = negatives(rows, blocks, n_negatives)
        named = spark.createDataFrame(searches, "search bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        real = lambda c: F.expr(f"nullif({c}, {_NULL_ID})")
        got = found.join(named, "search").select("anchor_id", real("positive_id").alias("positive_id"), "rank", real("id").alias("negative_id"),
                                                 "positive_score", F.col("score").alias("negative_score"))
        out.append(materialise(got, "negatives"))
    got = out[0] if out else spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    for more in out[1:]:
        got = got.union(more)
    return got
