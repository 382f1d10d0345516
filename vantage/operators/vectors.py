"""Distances and geometry comparison.

Row-pair operators (I8, I12, I14) compare every pair of rows, which is
quadratic; by default they run on the reference's bounded sample (the
first ``cap`` rows of each dataset, 300 by default), so the pair count per
group is at most cap * (cap - 1) / 2 whatever the size of the group
(``pair_moments`` sums over all pairs of whole groups instead).  The sample is cut with a ``WindowGroupLimit`` before any shuffle.  Only
``i < j`` pairs are built; the flattened square matrix of the reference
(both triangles plus the zero diagonal) is represented by weights: 2 for
each pair, 1 for each diagonal entry.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.operators.relational import head_per_group


def euclid(a: Column, b: Column) -> Column:
    """Euclidean distance of two equal-length double arrays (JVM-side)."""
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def as_vector(df: DataFrame, cols: Sequence[str], out: str = "vec") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def distance_pairs(df: DataFrame, by: Sequence[str], id_col: str, vec: str, cap: int | None = 300,
                   order: Sequence[str] | None = None) -> DataFrame:
    """I8: ``by, i, j, dist, w`` for i < j (w = 2) plus the diagonal (w = 1),
    over the first ``cap`` rows of each group in ``order`` (default ``id_col``)."""
    src = df.select(*by, id_col, vec, *[c for c in (order or []) if c not in (*by, id_col, vec)])
    if cap is not None:
        src = head_per_group(src, by, list(order or [id_col]), cap)
    a = src.select(*by, F.col(id_col).alias("i"), F.col(vec).alias("_va"))
    b = src.select(*by, F.col(id_col).alias("j"), F.col(vec).alias("_vb"))
    pairs = (a.join(b, list(by)).where(F.col("i") < F.col("j"))
              .select(*by, "i", "j", euclid(F.col("_va"), F.col("_vb")).alias("dist"), F.lit(2.0).alias("w")))
    diag = a.select(*by, "i", F.col("i").alias("j"), F.lit(0.0).alias("dist"), F.lit(1.0).alias("w"))
    return pairs.unionByName(diag)


def weighted_avg_rank(df: DataFrame, by: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """F1, weighted: rank of ``value`` in the multiset where each row counts
    ``weight`` times; ties get the average rank."""
    w_le = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    w_eq = Window.partitionBy(*by, value)
    return df.withColumn(out, F.sum(weight).over(w_le) - (F.sum(weight).over(w_eq) - 1.0) / 2.0)


def weighted_pearson(df: DataFrame, by: Sequence[str], x: str, y: str, w: str, out: str = "r") -> DataFrame:
    """Pearson correlation with row weights, from sums around the group's weighted means; null for a constant side."""
    by = list(by)
    ww = F.col(w)
    mid = df.groupBy(*by).agg((F.sum(ww * F.col(x)) / F.sum(ww)).alias("_mx"), (F.sum(ww * F.col(y)) / F.sum(ww)).alias("_my"))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    g = df.join(mid, by).groupBy(*by).agg(F.sum(ww * dx * dx).alias("_sxx"), F.sum(ww * dy * dy).alias("_syy"), F.sum(ww * dx * dy).alias("_sxy"))
    r = F.when((F.col("_sxx") > 0) & (F.col("_syy") > 0), F.col("_sxy") / F.sqrt(F.col("_sxx") * F.col("_syy")))
    return g.select(*by, r.alias(out))


def pair_cosine(df: DataFrame, by: Sequence[str], a: str, b: str, w: str | None = None, out: str = "cosine") -> DataFrame:
    """Cosine of two flattened matrices (weights = multiplicity)."""
    ww = F.col(w) if w else F.lit(1.0)
    g = df.groupBy(*by).agg(F.sum(ww * F.col(a) * F.col(b)).alias("_ab"), F.sum(ww * F.col(a) * F.col(a)).alias("_aa"),
                            F.sum(ww * F.col(b) * F.col(b)).alias("_bb"))
    return g.select(*by, F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb"))).alias(out))


def matrix_similarity(pairs: DataFrame, by: Sequence[str], a: str, b: str, w: str) -> DataFrame:
    """Spearman (weighted average ranks) and cosine of two flattened matrices."""
    r = weighted_avg_rank(weighted_avg_rank(pairs, by, a, w, "_ra"), by, b, w, "_rb")
    rho = weighted_pearson(r, by, "_ra", "_rb", w, "distance_correlation")
    cos = pair_cosine(pairs, by, a, b, w, "cosine_similarity")
    return rho.join(cos, list(by))


def distance_similarity(raw: DataFrame, emb: DataFrame, raw_cols: Sequence[str], cap: int = 300,
                        key: str = "dataset", id_col: str = "row_id") -> DataFrame:
    """Per (dataset, model), Spearman and cosine between the row-distance
    matrix of the raw features and that of the embeddings, first ``cap`` rows.

    The raw distances are computed once per dataset and joined to every
    model's embedding distances on (dataset, i, j).
    """
    rv = as_vector(raw, raw_cols, "_vec")
    # rows present on both sides, first ``cap`` of them in id order
    common = rv.select(key, id_col).join(emb.select(key, id_col).distinct(), [key, id_col], "left_semi")
    first = head_per_group(common, [key], [id_col], cap)
    rp = distance_pairs(rv.join(first, [key, id_col], "left_semi"), [key], id_col, "_vec", cap=None)
    ep = distance_pairs(emb.join(first, [key, id_col], "left_semi"), [key, "model"], id_col, "embedding", cap=None)
    j = ep.select(key, "model", "i", "j", F.col("dist").alias("d_emb"), "w").join(
        rp.select(key, "i", "j", F.col("dist").alias("d_raw")), [key, "i", "j"])
    return matrix_similarity(j, [key, "model"], "d_raw", "d_emb", "w")


def center_distances(centers: DataFrame, by: Sequence[str], cid: str = "cluster", vec: str = "center") -> DataFrame:
    """Centre-to-centre Euclidean distances, ``by, i, j, dist, w`` (i < j
    with weight 2, the zero diagonal with weight 1)."""
    return distance_pairs(centers, by, cid, vec, cap=None)


def silhouette(df: DataFrame, by: Sequence[str], id_col: str, vec: str, label: str, cap: int | None = 300,
               order: Sequence[str] | None = None) -> DataFrame:
    """Mean silhouette (exact Euclidean) of a labelling, first ``cap`` rows.

    a(i): mean distance to the other members of its cluster; b(i): the
    smallest mean distance to another cluster; s(i) = (b - a) / max(a, b),
    0 for singleton clusters (scikit-learn).  NULL with fewer than 2 labels.
    """
    src = df.select(*by, id_col, vec, label, *[c for c in (order or []) if c not in (*by, id_col, vec, label)])
    if cap is not None:
        src = head_per_group(src, by, list(order or [id_col]), cap)
    a = src.select(*by, F.col(id_col).alias("i"), F.col(vec).alias("_va"), F.col(label).alias("li"))
    b = src.select(*by, F.col(id_col).alias("j"), F.col(vec).alias("_vb"), F.col(label).alias("lj"))
    d = (a.join(b, list(by)).where(F.col("i") != F.col("j"))
          .select(*by, "i", "li", "lj", euclid(F.col("_va"), F.col("_vb")).alias("d")))
    per = d.groupBy(*by, "i", "li", "lj").agg(F.avg("d").alias("md"))
    sizes = src.groupBy(*by, F.col(label).alias("li")).agg(F.count(F.lit(1)).alias("sz"))
    s = per.groupBy(*by, "i", "li").agg(F.max(F.when(F.col("li") == F.col("lj"), F.col("md"))).alias("a"),
                                         F.min(F.when(F.col("li") != F.col("lj"), F.col("md"))).alias("b"))
    s = s.join(sizes, [*by, "li"])
    sil = F.when(F.col("sz") <= 1, F.lit(0.0)).otherwise(
        F.try_divide(F.col("b") - F.coalesce(F.col("a"), F.lit(0.0)),
                     F.greatest(F.coalesce(F.col("a"), F.lit(0.0)), F.col("b"))))
    return s.groupBy(*by).agg(F.when(F.count(F.col("b")) > 0, F.avg(sil)).alias("silhouette"),
                              F.count(F.lit(1)).alias("n"))


def silhouette_sq(df: DataFrame, by: Sequence[str], vec: str, label: str) -> DataFrame:
    """I14 over whole groups: mean silhouette with *squared* Euclidean distance
    (the metric of Spark's ``ClusteringEvaluator``), exact and without pairs.

    For squared distances the mean distance of x to cluster C is
    |x|^2 - 2 x.mu_C + mean_C |y|^2, so per-cluster sums (count, mean
    vector, mean squared norm) -- k rows per group -- are all that is needed;
    a(x) excludes x itself (factor n_C / (n_C - 1)).  Singletons score 0;
    NULL with fewer than 2 clusters.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    by = list(by)
    v = F.col(vec).cast("array<double>")
    sq = F.aggregate(F.transform(v, lambda t: t * t), F.lit(0.0), lambda a, t: a + t)
    src = df.select(*by, v.alias("_v"), F.col(label).alias("_l"), sq.alias("_sq"))
    cl = src.groupBy(*by, "_l").agg(F.count(F.lit(1)).alias("_n"), F.avg("_sq").alias("_m2"),
                                    vector_to_array(Summarizer.mean(array_to_vector("_v"))).alias("_mu"))
    packed = cl.groupBy(*by).agg(F.collect_list(F.struct("_l", "_n", "_m2", "_mu")).alias("_cs"))
    j = src.join(packed, by) if by else src.withColumn("_one", F.lit(1)).join(packed.withColumn("_one", F.lit(1)), "_one")

    def mean_d(c):
        dot = F.aggregate(F.zip_with(F.col("_v"), c["_mu"], lambda a, b: a * b), F.lit(0.0), lambda acc, t: acc + t)
        return F.col("_sq") - 2.0 * dot + c["_m2"]

    own = F.filter("_cs", lambda c: c["_l"] == F.col("_l"))[0]
    others = F.transform(F.filter("_cs", lambda c: c["_l"] != F.col("_l")), mean_d)
    a = F.when(own["_n"] > 1, mean_d(own) * own["_n"] / (own["_n"] - 1))
    b = F.array_min(others)
    s = F.when(own["_n"] <= 1, F.lit(0.0)).otherwise(F.try_divide(b - a, F.greatest(a, b)))
    scored = j.select(*by, s.alias("_s"), F.size("_cs").alias("_k"))
    return scored.groupBy(*by).agg(F.when(F.max("_k") > 1, F.avg("_s")).alias("silhouette_sq"),
                                   F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- whole-group forms (no pairs, no sample)

def mean_sq_distance(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """I8 / D7 over whole groups: mean squared distance of all ordered row pairs (diagonal included),
    which is twice the sum of the population variances: one aggregate."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.var_pop(F.col(c).cast("double"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.lit(2.0) * total).alias("mean_sq_dist"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` and ``y``, from coordinate differences (equal rows are at 0)."""
    out = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        t = x[:, d, None] - y[None, :, d]
        out += t * t
    return np.sqrt(out)


def pair_moments(df: DataFrame, by: Sequence[str], id_col: str, a: str, b: str | None = None, block: int = 4096) -> DataFrame:
    """I8 / I11 / D7 over whole groups: ``by, n, n_pairs`` and the sums of the Euclidean distances of all pairs of rows
    in ``a`` (``sum_a, sum_aa``), in ``b`` (``sum_b, sum_bb``) and of their products (``sum_ab``).

    Rows are dealt by a hash of the id into blocks of about ``block`` rows, and each pair of blocks is one task's
    group that returns its sums alone: the work is that of all pairs, no pair leaves a task, and a large group is
    many groups.  A row goes to n / ``block`` tiles.  Rows with a null vector or coordinate are left out.
    """
    by, b = list(by), b or a
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, lambda t: t.isNotNull())
    src = df.where(whole(a) & whole(b)).select(*by, id_col, F.col(a).cast("array<double>").alias("_x"), F.col(b).cast("array<double>").alias("_y"))
    sizes = src.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    dealt = src.join(sizes.withColumn("_blocks", F.ceil(F.col("n") / block)), by)
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64(id_col), F.col("_blocks"))).withColumn("_c", F.explode(F.expr("sequence(0, _blocks - 1)")))
    dealt = dealt.select(*by, "_b", F.least("_b", "_c").alias("_p"), F.greatest("_b", "_c").alias("_q"), "_x", *["_y"] * (b != a))
    sums = ["sum_a", "sum_aa", "sum_b", "sum_bb", "sum_ab"]

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        own = (pdf["_p"] == pdf["_q"]).iloc[0]
        left = (pdf["_b"] == pdf["_p"]).to_numpy()
        right = left if own else ~left
        total, pairs = np.zeros(5), 0
        if right.any() and left.any():
            x = np.stack(pdf["_x"].to_numpy())
            y = np.stack(pdf["_y"].to_numpy()) if b != a else None
            n, m = int(left.sum()), int(right.sum())
            pairs = n * (n - 1) // 2 if own else n * m
            for s in range(0, n, 64):
                da = _distances(x[left][s:s + 64], x[right])
                db = da if y is None else _distances(y[left][s:s + 64], y[right])
                if own:  # i < j
                    da, db = np.triu(da, s + 1), np.triu(db, s + 1)
                total += [da.sum(), (da * da).sum(), db.sum(), (db * db).sum(), (da * db).sum()]
        return pd.DataFrame([[*pdf[by].iloc[0], pairs, *total]], columns=[*by, "n_pairs", *sums])

    keys = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in by)
    tiles = dealt.groupBy(*by, "_p", "_q").applyInPandas(tile, f"{keys}, n_pairs bigint, " + ", ".join(f"{c} double" for c in sums))
    got = tiles.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_pairs", *sums)])
    return sizes.join(got, by)


def pair_cosine_whole(raw: DataFrame, emb: DataFrame, raw_cols: Sequence[str], key: str = "dataset", id_col: str = "row_id") -> DataFrame:
    """I11 over whole datasets: per (dataset, model) the cosine of the raw and the embedded row-distance matrix of all
    rows present on both sides (``n, cosine_similarity``); the zero diagonal adds nothing and mirrored pairs cancel."""
    j = emb.join(as_vector(raw, raw_cols, "_vec").select(key, id_col, "_vec"), [key, id_col])
    m = pair_moments(j, [key, "model"], id_col, "_vec", "embedding")
    return m.select(key, "model", "n", F.try_divide(F.col("sum_ab"), F.sqrt(F.col("sum_aa") * F.col("sum_bb"))).alias("cosine_similarity"))


def linear_cka(raw: DataFrame, emb: DataFrame, raw_cols: Sequence[str], dim: int, key: str = "dataset", id_col: str = "row_id",
               model: str = "model", vec: str = "embedding") -> DataFrame:
    """I12 over whole groups: similarity of raw and embedded row geometry as linear CKA,
    |Cxy|^2 / (|Cxx| |Cyy|) with Frobenius norms of the covariance matrices (the cosine of the two centred
    row-similarity matrices).  One join on the row and one aggregate; null for a constant side."""
    j = emb.join(raw.select(key, id_col, *raw_cols), [key, id_col])
    x = [F.col(c).cast("double") for c in raw_cols]
    y = [F.col(vec)[i].cast("double") for i in range(dim)]

    def norm2(a, b, same):
        terms = [(F.lit(1.0 if not same or i == k else 2.0)) * F.pow(F.covar_pop(u, v), 2)
                 for i, u in enumerate(a) for k, v in enumerate(b) if not same or k >= i]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    g = j.groupBy(key, model).agg(F.count(F.lit(1)).alias("n"), norm2(x, y, False).alias("_xy"), norm2(x, x, True).alias("_xx"), norm2(y, y, True).alias("_yy"))
    return g.select(key, model, "n", F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))).alias("cka"))
