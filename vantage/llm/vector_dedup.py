"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors at cosine >= t lie within squared distance 2 - 2t.  After a
seeded random rotation the vectors are split into blocks of ``block_dim``
coordinates; in at least one block the pair's squared distance is within the
block's share of the budget (in proportion to its size).  Each block is
range-joined on its own: a grid over the block's leading coordinate, cells as
wide as the block's radius, so partners lie in the same or the next cell; a
cell's vectors are dealt into tiles of bounded size, and each task sorts two
tiles by the leading coordinate, slides a window of the radius and tests the
block distance.  The survivors, a few in a million pairs that are no links, are
verified at once on the complete vectors in double precision.  A pair that
several blocks find counts in the first of them only.

Equal vectors are compared once, as a class.  A task returns one row per
vector with links (their number and one representative to stand for the
connection), never the pairs, so a dense group costs arithmetic but no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import bound_batches, col, components, materialise, roots

THRESHOLD, BLOCK_DIM, TILE_ROWS, SEED = 0.9, 16, 8192, 7
_CHUNK = 512
#: Room for rounding: the single-precision test keeps more than the budget, the double-precision one a hair more.
_SLACK32, _SLACK64 = 2e-5, 1e-9


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))[0]


def blocks(dim: int, block_dim: int) -> list[slice]:
    return [slice(a, min(dim, a + block_dim)) for a in range(0, dim, block_dim)]


def budgets(dim: int, block_dim: int, threshold: float) -> list[float]:
    return [(2 - 2 * threshold) * (b.stop - b.start) / dim for b in blocks(dim, block_dim)]


def units(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _flat(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def cells(classes: DataFrame, threshold: float, block_dim: int, seed: int) -> DataFrame:
    """``(cid, mult, vec, dim, block, cell)``: one row per vector and block, the cell of its leading rotated coordinate."""

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vec = part.column("vec")
            dims = np.diff(vec.offsets.to_numpy())
            for dim in np.unique(dims):
                own = part.filter(pa.array(dims == dim))
                n, d = own.num_rows, int(dim)
                x = own.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, d)
                y = units(x) @ rotation(d, seed)
                for k, (b, budget) in enumerate(zip(blocks(d, block_dim), budgets(d, block_dim, threshold))):
                    cell = np.floor(y[:, b.start] / np.sqrt(budget * (1 + 1e-6) + 1e-12)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [own.column("cid"), own.column("mult"), own.column("vec"), pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(cell)],
                        names=["cid", "mult", "vec", "dim", "block", "cell"])

    kind = classes.schema["vec"].dataType.simpleString()
    return classes.mapInArrow(place, f"cid bigint, mult bigint, vec {kind}, dim int, block int, cell bigint")


def tile_links(same: bool, a: np.ndarray, b: np.ndarray, mult_a: np.ndarray, mult_b: np.ndarray, block: int, threshold: float, block_dim: int,
               seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of two tiles (or within one) that ``block`` is the first to find.

    Returns the number of links of each row (a's, then b's, partners counted
    with their multiplicity) and a root for each row under these links.
    """
    dim, na, nb = a.shape[1], len(a), len(b)
    ua = units(a)
    ub = ua if same else units(b)
    rot = rotation(dim, seed)
    ya = ua @ rot
    yb = ya if same else ub @ rot
    cut, budget = blocks(dim, block_dim), budgets(dim, block_dim, threshold)
    lead, radius = cut[block].start, np.sqrt(budget[block] * (1 + 1e-6) + 1e-12)
    oa = np.argsort(ya[:, lead], kind="stable")
    ob = oa if same else np.argsort(yb[:, lead], kind="stable")
    ka, kb = ya[oa, lead], yb[ob, lead]
    pa_, pb = ya[oa, cut[block]].astype(np.float32), yb[ob, cut[block]].astype(np.float32)
    one = np.ones((na, 1), np.float32), np.ones((nb, 1), np.float32)
    left = np.hstack([-2 * pa_, (pa_ * pa_).sum(1, keepdims=True), one[0]])
    right = np.hstack([pb, one[1], (pb * pb).sum(1, keepdims=True)])
    count_a, count_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    lab = np.arange(na if same else na + nb)
    for at in range(0, na, _CHUNK):
        end = min(na, at + _CHUNK)
        lo = at if same else int(np.searchsorted(kb, ka[at] - radius, "left"))
        hi = int(np.searchsorted(kb, ka[end - 1] + radius, "right"))
        if hi <= lo:
            continue
        near = left[at:end] @ right[lo:hi].T <= budget[block] + _SLACK32
        if same:  # each unordered pair once: later rows only
            near &= np.arange(lo, hi)[None, :] > np.arange(at, end)[:, None]
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        for c in range(0, len(cols), 2048):
            ra, cb = oa[at + rows], ob[lo + cols[c:c + 2048]]
            sub = near[np.ix_(rows, cols[c:c + 2048])]
            link = sub & (ua[ra] @ ub[cb].T >= threshold)
            if not link.any():
                continue
            i, j = np.nonzero(link)
            for k in range(block + 1):  # this block must hold exactly, the ones before must not
                za, zb = ya[ra, cut[k]], yb[cb, cut[k]]
                d = (za * za).sum(1)[i] + (zb * zb).sum(1)[j] - 2 * (za @ zb.T)[i, j]
                ok = d <= budget[k] * (1 + _SLACK64) + 1e-12
                i, j = (i[ok], j[ok]) if k == block else (i[~ok], j[~ok])
            gi, gj = ra[i], cb[j]
            np.add.at(count_a, gi, mult_b[gj])
            np.add.at(count_a if same else count_b, gj, mult_a[gi])
            li, lj = lab[gi], lab[gj if same else na + gj]
            merged = roots(len(lab), li, lj)
            lab = merged[lab]
    return (count_a if same else np.concatenate([count_a, count_b])), lab


def vector_links(classes: DataFrame, threshold: float = THRESHOLD, block_dim: int = BLOCK_DIM, tile_rows: int = TILE_ROWS, seed: int = SEED) -> DataFrame:
    """``classes(cid, mult, vec)`` distinct usable vectors -> ``(cid, links, root)`` rows: links found by one task, and one vector they connect to."""
    placed = materialise(cells(classes, threshold, block_dim, seed), "vector-cells")
    key = ["dim", "block", "cell"]
    count = placed.groupBy(*key).count().withColumn("subs", F.ceil(F.col("count") / tile_rows).cast("int"))
    count = materialise(count.select(*key, "subs"), "vector-counts")
    tiles = count.select(*key, F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    # tile pairs: a cell with itself and with the next one
    other = tiles.select("dim", "block", F.col("cell").alias("cell2"), F.col("sub").alias("sub2"))
    reach = tiles.withColumn("cell2", F.explode(F.array(F.col("cell"), F.col("cell") + 1)))
    pairs = reach.join(other, ["dim", "block", "cell2"]).where("cell2 > cell or sub2 >= sub")
    pairs = pairs.withColumns({"pair": F.monotonically_increasing_id(), "own": F.expr("cell2 = cell and sub2 = sub")})
    pairs = materialise(pairs, "vector-tile-pairs")
    one = pairs.select(*key, "sub", "pair", "own", F.lit(0).alias("side"))
    two = pairs.where("not own").select("dim", "block", F.col("cell2").alias("cell"), F.col("sub2").alias("sub"), "pair", "own", F.lit(1).alias("side"))
    dealt = placed.join(count, key).withColumn("sub", F.pmod(F.xxhash64("cid"), F.col("subs")).cast("int"))
    dealt = dealt.join(one.union(two), [*key, "sub"]).select("pair", "own", "side", "block", "cid", "mult", "vec")

    def compare(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        block = int(t.column("block")[0].as_py())
        part = [t.filter(pa.array(side == s)) for s in (0, 1)]
        same = bool(t.column("own")[0].as_py())
        x = [_flat(p.column("vec"), p.num_rows) for p in part]
        mult = [p.column("mult").to_numpy() for p in part]
        cid = np.concatenate([p.column("cid").to_numpy() for p in part])
        if not same and min(map(len, x)) == 0:
            return pa.table({"cid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        links, lab = tile_links(same, x[0], x[0] if same else x[1], mult[0], mult[0] if same else mult[1], block, threshold, block_dim, seed)
        at = np.flatnonzero(links)
        return pa.table({"cid": pa.array(cid[at]), "links": pa.array(links[at]), "root": pa.array(cid[lab[at]])})

    return dealt.groupBy("pair").applyInArrow(compare, "cid bigint, links bigint, root bigint")


def vector_components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, block_dim: int = BLOCK_DIM,
                      tile_rows: int = TILE_ROWS, seed: int = SEED) -> DataFrame:
    """One row per input row: ``id_col, n_links, component_id, kept``.

    Vectors that are null, zero or hold null or non-finite components, and
    vectors without an id, link with nothing (their own component, kept if
    they have an id).  Vectors of different length do not link.  Repeated
    rows count as vectors of their own.  An empty table gives no rows.
    """
    bound_batches(df.sparkSession)
    kind = df.schema[vec_col].dataType.simpleString()
    src = df.select(col(id_col).cast("bigint").alias("id"), col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("vec"))
    fit = src.where(usable(F.col("vec")) & F.col("id").isNotNull())
    classes = materialise(fit.groupBy("vec").agg(F.min("id").alias("cid"), F.count("*").alias("mult")), "vector-classes")
    links = materialise(vector_links(classes.select("cid", "mult", "vec"), threshold, block_dim, tile_rows, seed), "vector-links")
    comp = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b"))).toDF("cid", "comp")
    n = links.groupBy("cid").agg(F.sum("links").alias("links"))
    least = comp.groupBy("comp").agg(F.min("cid").alias("component"))
    named = classes.join(n, "cid", "left").join(comp.join(least, "comp").select("cid", "component"), "cid", "left")
    named = materialise(named.select(F.col("vec").alias("cvec"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                                     F.coalesce("component", "cid").alias("component")), "vector-groups")
    out = src.join(named, (F.col("vec") == F.col("cvec")) & F.col("id").isNotNull(), "left")
    comp_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), comp_id.alias("component_id"),
                      F.coalesce(F.col("id") == comp_id, F.lit(False)).alias("kept"))
