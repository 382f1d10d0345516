"""K-means for every group at once, seeded by squared distance.

Points never move after they were packed into chunks.  A group's runs (every
wanted k times ``n_init`` restarts) are one row that travels to its chunks:

* seeding: the first centre of a restart is a draw among all points, each next
  one a draw with weight D^2, the squared distance to the nearest centre so
  far.  A draw is the least ``-log(u) / D^2`` over the group with u hashed from
  (point, restart, step): a minimum per restart, so it needs no order and no
  second pass and gives the same points under any partitioning.  The runs for
  several k share the seeds, each takes its first k;
* Lloyd's steps: each chunk returns, per run that still moves, the counts and
  sums of its clusters and its inertia as one vector; one grouped sum makes the
  new centres.

A group of up to ``group_rows`` points goes through the same functions in one
task; larger groups take one job per step for all of them together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.operators.chunked import apply_models, each_row, packed, spread, write_once
from vantage.operators.trees import arrow_schema, mixed
from vantage.session import ship_package

GROUP_ROWS = 50_000
_BLOCK = 16_384


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, from centred numbers (callers subtract the group's mean)."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0.0)


def candidate(x: np.ndarray, h: np.ndarray, near: np.ndarray | None, run: int, step: int, seed: int) -> tuple[float, int]:
    """Least draw of one restart's step among the points: ``(value, point)``; points on a centre already only if there are no others."""
    u = (mixed(h, run, step, seed).astype(np.float64) + 0.5) / 2.0**64
    value = -np.log(np.minimum(u, 1 - 2.0**-53))
    if near is not None:
        value = np.where(near > 0, value / np.where(near > 0, near, 1.0), 1e300 * (1 + value / 1e3))
    at = int(np.argmin(value))
    return float(value[at]), at


def cluster_sums(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Counts, sums (flat) and inertia of the points by nearest centre."""
    k, d = centers.shape
    count, total, inertia = np.zeros(k), np.zeros((k, d)), 0.0
    for a in range(0, len(x), _BLOCK):
        part = x[a:a + _BLOCK]
        dist = distances(part, centers)
        own = dist.argmin(1)
        count += np.bincount(own, minlength=k)
        for j in range(d):
            total[:, j] += np.bincount(own, part[:, j], k)
        inertia += float(dist[np.arange(len(part)), own].sum())
    return np.concatenate([count, total.ravel(), [inertia]])


def moved(centers: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, float]:
    """New centres (an empty cluster keeps its own) and their squared shift."""
    k, d = centers.shape
    count, total = sums[:k], sums[k:k + k * d].reshape(k, d)
    new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return new, float(((new - centers) ** 2).sum())


def near_centers(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest centre, exactly nought on a centre."""
    out = np.full(len(x), np.inf)
    for c in centers:
        out = np.minimum(out, ((x - c) ** 2).sum(1))
    return out


def fit_in_memory(x: np.ndarray, h: np.ndarray, ks: Sequence[int], n_init: int, max_iter: int, tol: float, seed: int) -> list[dict]:
    """Best run of each k over centred points, as ``moved`` and ``candidate`` give it."""
    limit = tol * float(x.var(0).mean()) if x.size else 0.0
    best: dict[int, dict] = {}
    for run in range(n_init):
        seeds, near = [], None
        for step in range(max(ks)):
            _, at = candidate(x, h, near, run, step, seed)
            seeds.append(x[at])
            far = ((x - x[at]) ** 2).sum(1)
            near = far if near is None else np.minimum(near, far)
        for k in ks:
            c, converged, it = np.array(seeds[:k]), False, 0
            while it < max_iter and not converged:
                c, shift = moved(c, cluster_sums(x, c))
                converged, it = shift <= limit, it + 1
            inertia = cluster_sums(x, c)[-1]
            if k not in best or inertia < best[k]["inertia"]:
                best[k] = {"k": int(k), "run": run, "inertia": float(inertia), "converged": bool(converged), "iterations": it, "centers": c}
    return [best[k] for k in ks]


MODEL = "k int, run int, inertia double, converged boolean, iterations int, centers array<array<double>>"
RUN = "struct<k: int, run: int, moving: boolean, converged: boolean, iterations: int, inertia: double, centers: array<array<double>>>"


def fit_kmeans(df: DataFrame, by: Sequence[str], key: str, vec: str, ks: Sequence[int] | str, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, seed: int = 42,
               group_rows: int = GROUP_ROWS) -> DataFrame:
    """Best of ``n_init`` runs per group and k: ``by, k, run, inertia, converged, iterations, centers``.

    ``ks`` lists the numbers of clusters, or names a column of ``by`` that
    holds the group's own.  A run has converged when the squared shift of its
    centres is at most ``tol`` times the mean variance of the group's features;
    ``max_iter`` steps end it in any case.  Rows without group or vector do not
    count; a group with fewer distinct points than k has empty clusters on
    repeated centres.
    """
    by = list(by)
    ship_package(df.sparkSession)
    src = df.select(*by, F.col(key).alias("_key"), F.col(vec).cast("array<double>").alias("_x")).dropna(subset=[*by, "_x"])
    stats = src.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), vector_to_array(Summarizer.mean(array_to_vector("_x"))).alias("_mean"),
                                 vector_to_array(Summarizer.variance(array_to_vector("_x"))).alias("_var"))
    wanted = F.array(F.col(ks).cast("int")) if isinstance(ks, str) else F.array(*[F.lit(int(k)) for k in ks])
    base = write_once(stats.select(*by, "_n", "_mean", "_var", wanted.alias("_ks")), "kmeans-groups")
    names = ", ".join(f"`{b}` {t}" for b, t in base.select(*by).dtypes)
    schema = f"{names}, {MODEL}"
    as_model = arrow_schema(df, schema)

    def whole(rows: pa.Table, group: pa.Table) -> pa.Table:
        if not rows.num_rows or not group.num_rows:
            return as_model.empty_table()
        g = group.to_pylist()[0]
        x = rows.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        h, mean = rows.column("_h").to_numpy(), np.array(g["_mean"])
        order = np.argsort(h, kind="stable")
        found = fit_in_memory(x[order] - mean, h[order], g["_ks"], n_init, max_iter, tol, seed)
        return pa.Table.from_pylist([{**{b: g[b] for b in by}, **f, "centers": (f["centers"] + mean).tolist()} for f in found], schema=as_model)

    small = base.where(F.col("_n") <= group_rows)
    rows = src.join(small.select(*by), by, "left_semi").select(*by, "_x", F.xxhash64("_key").alias("_h"))
    local = spread(rows, by).groupBy(*by).cogroup(spread(small, by).groupBy(*by)).applyInArrow(whole, schema)
    large = base.where(F.col("_n") > group_rows)
    if large.isEmpty():
        return local
    return local.unionByName(fit_chunked(src.join(large.select(*by), by, "left_semi"), large, by, names, n_init, max_iter, tol, seed))


def fit_chunked(src: DataFrame, base: DataFrame, by: list[str], names: str, n_init: int, max_iter: int, tol: float, seed: int) -> DataFrame:
    """``fit_kmeans`` for groups of any size: a job per seeding step and per Lloyd step, all groups and runs together."""
    chunks = write_once(packed(src.withColumn("_y", F.lit(0.0)), by, "_x", "_y", "_key"), "kmeans-chunks")
    keyed = lambda r: {b: r[b] for b in by}

    def points(r: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(r["x"], "<f8").reshape(r["n"], -1) - np.array(r["_mean"]), np.frombuffer(r["h"], "<i8")

    seed_schema = f"{names}, run int, value double, point array<double>"
    as_seed = arrow_schema(src, seed_schema)

    def draw(r: dict) -> list[dict]:
        x, h = points(r)
        out = []
        for run in range(n_init):
            have = [np.array(p) for p in r["seeds"][run]] if r["seeds"] else []
            value, at = candidate(x, h, near_centers(x, np.array(have)) if have else None, run, len(have), seed)
            out.append({**keyed(r), "run": run, "value": value, "point": x[at].tolist()})
        return out

    groups = base.withColumn("_kmax", F.array_max("_ks"))
    state = groups.withColumn("seeds", F.lit(None).cast("array<array<array<double>>>"))
    most = groups.agg(F.max("_kmax")).first()[0]
    for step in range(most):
        growing = state.where(F.col("_kmax") > step)
        drawn = chunks.join(growing.select(*by, "_mean", "seeds"), by).mapInArrow(each_row(draw, as_seed), seed_schema)
        won = drawn.groupBy(*by, "run").agg(F.min_by("point", F.struct("value", "point")).alias("point"))
        won = won.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "point"))), lambda s: s["point"]).alias("_new"))
        joined = state.join(won, by, "left")
        first = F.transform("_new", lambda p: F.array(p))
        longer = F.zip_with("seeds", "_new", lambda s, p: F.concat(s, F.array(p)))
        seeds = F.when(F.col("_new").isNull(), F.col("seeds")).when(F.col("seeds").isNull(), first).otherwise(longer)
        state = write_once(joined.withColumn("seeds", seeds).drop("_new"), "kmeans-seeds")

    runs_schema = f"{names}, _mean array<double>, _limit double, runs array<{RUN}>"
    as_runs = arrow_schema(src, runs_schema)

    def begin(r: dict) -> list[dict]:
        n = r["_n"]
        limit = tol * float(np.mean(r["_var"])) * (n - 1) / n
        runs = [{"k": k, "run": run, "moving": True, "converged": False, "iterations": 0, "inertia": None, "centers": seeds[:k]}
                for k in r["_ks"] for run, seeds in enumerate(r["seeds"])]
        return [{**keyed(r), "_mean": r["_mean"], "_limit": limit, "runs": runs}]

    part_schema = f"{names}, at int, sums array<double>"
    as_part = arrow_schema(src, part_schema)

    def assign(r: dict) -> list[dict]:
        x, _ = points(r)
        return [{**keyed(r), "at": i, "sums": cluster_sums(x, np.array(run["centers"])).tolist()} for i, run in enumerate(r["runs"]) if run["moving"] or run["inertia"] is None]

    def step_all(r: dict) -> list[dict]:
        for s in r.pop("found"):
            run, total = r["runs"][s["at"]], np.array(s["sums"])
            if not run["moving"]:
                run["inertia"] = float(total[-1])
                continue
            c, shift = moved(np.array(run["centers"]), total)
            run["iterations"] += 1
            run["converged"] = shift <= r["_limit"]
            run["moving"] = not run["converged"] and run["iterations"] < max_iter
            run["centers"] = c.tolist()
        return [r]

    state = write_once(state.mapInArrow(each_row(begin, as_runs), runs_schema), "kmeans-runs")
    ended: DataFrame | None = None
    while True:
        open_ = F.exists("runs", lambda r: r["moving"] | r["inertia"].isNull())
        rest = state.where(~open_)
        ended = rest if ended is None else ended.unionByName(rest)
        state = state.where(open_)
        if state.isEmpty():
            break
        parts = chunks.join(state.select(*by, "_mean", "runs"), by).mapInArrow(each_row(assign, as_part), part_schema)
        total = parts.groupBy(*by, "at").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        found = total.groupBy(*by).agg(F.collect_list(F.struct("at", "sums")).alias("found"))
        state = write_once(state.join(found, by).mapInArrow(each_row(step_all, as_runs), runs_schema), "kmeans-runs")
    tall = ended.select(*by, "_mean", F.explode("runs").alias("r"))
    best = tall.groupBy(*by, F.col("r.k").alias("k")).agg(F.min_by(F.struct("r", "_mean"), F.struct("r.inertia", "r.run")).alias("b"))
    back = F.transform("b.r.centers", lambda c: F.zip_with(c, F.col("b._mean"), lambda a, m: a + m))
    return best.select(*by, "k", "b.r.run", "b.r.inertia", "b.r.converged", "b.r.iterations", back.alias("centers"))


def nearest(rows: DataFrame, models: DataFrame, by: Sequence[str], key: str, vec: str) -> DataFrame:
    """``by, key, _cid, dist2``: the nearest centre of each row's group and its squared distance."""
    by = list(by)
    kinds = dict(rows.dtypes)
    names = [*by, key]

    def one(t: pa.Table, m: pa.Table) -> pa.Table:
        n = t.num_rows if m.num_rows else 0
        own, dist = np.zeros(0, np.int32), np.zeros(0)
        if n:
            x = t.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            c = np.array(m.column("centers")[0].as_py())
            mean = c.mean(0)
            own = np.concatenate([distances(x[a:a + _BLOCK] - mean, c - mean).argmin(1) for a in range(0, n, _BLOCK)]).astype(np.int32)
            dist = ((x - c[own]) ** 2).sum(1)
        t = t.slice(0, n)
        return pa.table({**{c: t.column(c) for c in names}, "_cid": pa.array(own), "dist2": pa.array(dist)})

    src = rows.select(*by, key, F.col(vec).cast("array<double>").alias("_x")).where(F.col("_x").isNotNull())
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", _cid int, dist2 double"
    return apply_models(src, models, by, key, one, schema)


def kmeans(df: DataFrame, by: Sequence[str], id_col: str, vec: str, k: int | str, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, seed: int = 42,
           group_rows: int = GROUP_ROWS):
    """``(assign, centers, cost)`` of the best run per group: labels per row (numbered by each cluster's smallest id), centres
    per (group, cluster) and the inertia with its ``converged`` flag.  ``k`` is a number or the name of a column among ``by``."""
    by = list(by)
    if isinstance(k, str):  # the models' own column is called k
        own = ["_own_k" if b == k else b for b in by]
        parts = kmeans_labels(df.withColumnRenamed(k, "_own_k"), own, id_col, vec, "_own_k", n_init, max_iter, tol, seed, group_rows)
        return tuple(p.withColumnRenamed("_own_k", k) for p in parts)
    return kmeans_labels(df, by, id_col, vec, [k], n_init, max_iter, tol, seed, group_rows)


def kmeans_labels(df: DataFrame, by: list[str], id_col: str, vec: str, ks: Sequence[int] | str, n_init: int, max_iter: int, tol: float, seed: int, group_rows: int):
    models = write_once(fit_kmeans(df, by, id_col, vec, ks, n_init, max_iter, tol, seed, group_rows), "kmeans-models")
    got = write_once(nearest(df, models, by, id_col, vec), "kmeans-labels")
    first = got.groupBy(*by, "_cid").agg(F.min(id_col).alias("_first"))
    relabel = first.withColumn("cluster", F.row_number().over(Window.partitionBy(*by).orderBy("_first")) - 1).drop("_first")  # k rows a group
    assign = got.join(relabel, [*by, "_cid"]).select(*by, id_col, "cluster", "dist2")
    tall = models.select(*by, F.posexplode("centers").alias("_cid", "center"))
    centers = tall.join(relabel, [*by, "_cid"]).select(*by, "cluster", "center")
    return assign, centers, models.select(*by, "inertia", "converged")


def elbow_curve(df: DataFrame, by: Sequence[str], id_col: str, vec: str, kmax: int = 9, n_init: int = 10, seed: int = 42) -> DataFrame:
    """I4: K-means inertia for k = 1..kmax, ``by, k, inertia, converged``; the restarts of all k share their seeds."""
    m = fit_kmeans(df, by, id_col, vec, range(1, kmax + 1), n_init=n_init, seed=seed)
    return m.select(*by, "k", "inertia", "converged")
