"""Elbows, choices of k and the cluster-geometry
comparisons, on top of grouped K-means (``kmeans``) and PCA (``pca``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.operators.kmeans import elbow_curve, kmeans
from vantage.operators.pca import pca

__all__ = ["assign_clusters", "audit_rows", "bin_inertia_curve", "choose_k", "cluster_count_summary", "cluster_similarity", "elbow_curve", "elbow_k", "elbows",
           "kmeans", "pca"]


def bin_inertia_curve(df: DataFrame, by: Sequence[str], x: str, y: str, kmax: int = 9) -> DataFrame:
    """Deterministic inertia curve: for k = 1..kmax, the within-bin sum of
    squares of ``y`` over k equal-width bins of ``x``.  One aggregate for
    the ranges, one for all k at once (rows are repeated per k)."""
    rng = df.groupBy(*by).agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    j = df.select(*by, x, y).join(rng, list(by)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(kmax))))
    frac = F.when(F.col("_mx") > F.col("_mn"), (F.col(x) - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))).otherwise(0.0)
    j = j.withColumn("b", F.least(F.floor(frac * F.col("k")), F.col("k") - 1))
    yv = F.col(y)
    ss = j.groupBy(*by, "k", "b").agg((F.var_pop(yv) * F.count(F.lit(1))).alias("ss"))
    return ss.groupBy(*by, F.col("k").cast("bigint").alias("k")).agg(F.sum("ss").alias("inertia"))


def elbow_k(curve: DataFrame, by: Sequence[str], k: str = "k", inertia: str = "inertia",
            rule: str = "reference") -> DataFrame:
    """I4: elbow of an inertia curve from its second difference.

    ``rule="reference"``: arg-min of the second difference + 2 (the
    reference's rule); ``rule="max_curvature"``: arg-max + 2 (the usual
    elbow).  Curves with fewer than 3 points give k = 1.  Ties go to the
    smallest k.
    """
    w = Window.partitionBy(*by).orderBy(k)
    v = F.col(inertia)
    c = curve.withColumn("_d2", F.lead(v, 2).over(w) - 2 * F.lead(v, 1).over(w) + v)
    key = F.col("_d2") if rule == "reference" else -F.col("_d2")
    g = c.groupBy(*by).agg(
        F.min_by(F.col(k), F.when(F.col("_d2").isNotNull(), F.struct(key.alias("d"), F.col(k).alias("k")))).alias("_k0"),
        F.count(F.col("_d2")).alias("_nd"))
    return g.select(*by, F.when(F.col("_nd") > 0, F.col("_k0") + 1).otherwise(F.lit(1)).cast("bigint").alias("elbow_k"))


def choose_k(df: DataFrame, by: Sequence[str], cols: Sequence[str], lo: int = 2, hi: int = 10,
             cap: int | None = None) -> DataFrame:
    """k = max(lo, min(hi, distinct rows)), optionally capped by the sample size."""
    g = df.groupBy(*by).agg(F.countDistinct(*cols).alias("_nd"), F.count(F.lit(1)).alias("_n"))
    k = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("_nd")))
    if cap is not None:
        k = F.least(k, F.least(F.col("_n"), F.lit(cap)))
    return g.select(*by, k.cast("int").alias("k"))


# ---------------------------------------------------------------- I5, I9, I10, I13, I15

def _first_rows(df, key, id_col, cap):
    from vantage.operators.relational import head_per_group
    return head_per_group(df, [key], [id_col], cap) if cap else df


def cluster_similarity(raw: DataFrame, emb: DataFrame, raw_cols: Sequence[str], k: int | DataFrame = 5,
                       cap: int | None = None, key: str = "dataset", id_col: str = "row_id", n_init: int = 10) -> DataFrame:
    """Per (dataset, model): K-means on the raw features and on the
    embeddings of all rows (with ``cap`` the first ones), then Spearman and cosine of
    the two centre-to-centre distance matrices.

    ``k`` is one number or a table ``(key, k)`` with a k of its own for each
    dataset.

    Deviation: K-means labels are arbitrary, so centres are paired by their
    first-appearance order (smallest row id) rather than by raw label.
    """
    from vantage.operators.vectors import center_distances, matrix_similarity

    first = _first_rows(raw.select(key, id_col).join(emb.select(key, id_col).distinct(), [key, id_col], "left_semi"),
                        key, id_col, cap)
    rv = raw.join(first, [key, id_col], "left_semi").withColumn("_vec", F.array(*[F.col(c).cast("double") for c in raw_cols]))
    ev = emb.join(first, [key, id_col], "left_semi")
    if isinstance(k, DataFrame):
        rv, ev = (x.join(k.select(key, F.col("k").alias("_k")), key) for x in (rv, ev))
        _, rc, _ = kmeans(rv, [key, "_k"], id_col, "_vec", "_k", n_init=n_init)
        _, ec, _ = kmeans(ev, [key, "model", "_k"], id_col, "embedding", "_k", n_init=n_init)
    else:
        _, rc, _ = kmeans(rv, [key], id_col, "_vec", k, n_init=n_init)
        _, ec, _ = kmeans(ev, [key, "model"], id_col, "embedding", k, n_init=n_init)
    rd = center_distances(rc, [key]).select(key, "i", "j", F.col("dist").alias("d_raw"))
    ed = center_distances(ec, [key, "model"]).select(key, "model", "i", "j", F.col("dist").alias("d_emb"), "w")
    return matrix_similarity(ed.join(rd, [key, "i", "j"]), [key, "model"], "d_raw", "d_emb", "w")


def assign_clusters(samples: DataFrame, emb: DataFrame, models: Sequence[str], k: int = 2, key: str = "dataset",
                    id_col: str = "row_id", n_init: int = 10) -> DataFrame:
    """``cluster_<model>`` label columns, for the named models, beside the sample rows."""
    emb = emb.where(F.col("model").isin(*models))
    a, _, _ = kmeans(emb, [key, "model"], id_col, "embedding", k, n_init=n_init)
    wide = a.groupBy(key, id_col).pivot("model", models).agg(F.first("cluster"))
    return samples.join(wide.select(key, id_col, *[F.col(m).alias(f"cluster_{m}") for m in models]), [key, id_col], "left")


def elbows(emb: DataFrame, by: Sequence[str], id_col: str, vec: str, kmax: int = 9, n_init: int = 10, max_components: int = 50, plane: int = 2) -> DataFrame:
    """I4: ``by, k_reference, k_max_curvature, converged`` from the K-means inertia over k = 1..kmax.

    Vectors are reduced to ``min(max_components, rows, width)`` principal
    components, and their first ``plane`` (the place of a non-linear map) are
    clustered.  k runs below the number of rows; fewer than three values of k
    give 1.
    """
    by = list(by)
    scores, _ = pca(emb, by, id_col, vec, k=max_components)
    flat = scores.withColumn("scores", F.slice("scores", 1, plane))
    n = flat.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    curve = elbow_curve(flat, by, id_col, "scores", kmax, n_init).join(n, by).where((F.col("k") < F.col("_n")) | (F.col("k") == 1))
    a = elbow_k(curve, by, rule="reference").withColumnRenamed("elbow_k", "k_reference")
    b = elbow_k(curve, by, rule="max_curvature").withColumnRenamed("elbow_k", "k_max_curvature")
    return a.join(b, by).join(curve.groupBy(*by).agg(F.every("converged").alias("converged")), by)


def cluster_count_summary(emb: DataFrame, kinds: DataFrame, original: int = 4, kmax: int = 9, key: str = "dataset", id_col: str = "row_id", vec: str = "embedding",
                          n_init: int = 10) -> DataFrame:
    """Per (model, equation) the mean and deviation of the elbow k beside the number of clusters the data were made of.

    ``kinds`` names each dataset's equation: ``(key, equation)``.  Datasets
    with fewer than five rows do not count.
    """
    enough = emb.groupBy(key, "model").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 5)
    ks = elbows(emb.join(enough, [key, "model"], "left_semi"), [key, "model"], id_col, vec, kmax, n_init).join(kinds, key)
    return ks.groupBy("model", "equation").agg(F.count(F.lit(1)).alias("n"), F.avg("k_reference").alias("computed_clusters_mean"),
                                               F.stddev_samp("k_reference").alias("computed_clusters_std"), F.lit(float(original)).alias("original_clusters_mean"))


def audit_rows(raw: DataFrame, emb: DataFrame, best: DataFrame, raw_cols: Sequence[str], k: int = 4, key: str = "dataset", id_col: str = "row_id", vec: str = "embedding",
               n_init: int = 10) -> DataFrame:
    """Both sides of each model's chosen dataset (``best(model, key)``), row by row: ``model, key, side, id, c1, c2, cluster``.

    ``side`` is raw or embedded; ``c1, c2`` are the first two principal
    components (0 where a side has fewer columns), ``cluster`` its K-means
    label with ``k`` clusters.  Rows that one side lacks are left out.
    """
    held = raw.select(key, id_col, F.array(*[F.col(c).cast("double") for c in raw_cols]).alias("_v")).join(best, key)
    embedded = emb.join(best, [key, "model"], "left_semi").select(key, "model", id_col, F.col(vec).cast("array<double>").alias("_v"))
    both = [key, "model", id_col]
    sides = held.join(embedded.select(*both), both, "left_semi").select(*both, "_v", F.lit("raw").alias("side")).unionByName(
        embedded.join(held.select(*both), both, "left_semi").withColumn("side", F.lit("embedded")))
    out = None
    for side in ("raw", "embedded"):  # the sides differ in width
        rows = sides.where(F.col("side") == side)
        scores, _ = pca(rows, ["model", key], id_col, "_v", k=2)
        labels, _, _ = kmeans(scores, ["model", key], id_col, "scores", k, n_init=n_init)
        one = scores.join(labels, ["model", key, id_col]).select("model", key, F.lit(side).alias("side"), id_col, F.col("scores")[0].alias("c1"),
                                                                 F.coalesce(F.get("scores", F.lit(1)), F.lit(0.0)).alias("c2"), "cluster")
        out = one if out is None else out.unionByName(one)
    return out
