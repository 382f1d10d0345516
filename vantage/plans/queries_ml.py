"""Registered queries for I (vectors, clustering), J (features) and K (models).

Deterministic operators have DuckDB twins; iterative ones (K-means,
Gauss-Newton, MLlib fits, PCA) have none and are covered by property
tests in ``tests/``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions import expr as B
from vantage.operators import cluster as CL
from vantage.operators import features as J
from vantage.operators import models as K
from vantage.operators import relational as RL
from vantage.operators import vectors as VX
from vantage.plans import duck as D
from vantage.plans import reports as R
from vantage.plans.catalog import register
from vantage.plans.queries_base import CHOSEN, REQUESTED, _chosen_col, _chosen_sql, base
from vantage.sources import testdata as V

r6 = D.r6
CAP = 300


# ---------------------------------------------------------------- shared SQL

def first_rows_sql(src: str, cap: int = CAP) -> str:
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY row_id) AS rn "
            f"FROM {src}) t WHERE rn <= {cap}")


def dist_pairs_sql(src: str, by: str, vec_a: str, vec_b: str) -> str:
    """i < j pairs (w = 2) plus the diagonal (w = 1) over ``src`` rows."""
    keys = by.split(", ")
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    sel = ", ".join(f"a.{k}" for k in keys)
    return f"""
SELECT {sel}, a.row_id AS i, b.row_id AS j,
       sqrt(list_sum(list_transform(list_zip({vec_a}, {vec_b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist,
       2.0::DOUBLE AS w FROM {src} a JOIN {src} b ON {on} AND a.row_id < b.row_id
UNION ALL SELECT {by}, row_id, row_id, 0.0::DOUBLE, 1.0::DOUBLE FROM {src}"""


def matrix_similarity_sql(q: D.CTE, src: str, by: str, a: str, b: str, w: str, tag: str) -> str:
    q.add(f"{tag}_r", f"""SELECT *, sum({w}) OVER (PARTITION BY {by} ORDER BY {a}) - (sum({w}) OVER (PARTITION BY {by}, {a}) - 1.0) / 2.0 AS ra,
       sum({w}) OVER (PARTITION BY {by} ORDER BY {b}) - (sum({w}) OVER (PARTITION BY {by}, {b}) - 1.0) / 2.0 AS rb FROM {src}""")
    q.add(f"{tag}_g", f"""SELECT {by}, sum({w}) AS sw, sum({w} * ra) AS sx, sum({w} * rb) AS sy, sum({w} * ra * ra) AS sxx,
       sum({w} * rb * rb) AS syy, sum({w} * ra * rb) AS sxy, sum({w} * {a} * {b}) AS ab, sum({w} * {a} * {a}) AS aa,
       sum({w} * {b} * {b}) AS bb FROM {tag}_r GROUP BY {by}""")
    cxy, cxx, cyy = "(sxy - sx * sy / sw)", "(sxx - sx * sx / sw)", "(syy - sy * sy / sw)"
    return f"""SELECT {by}, {r6(f'CASE WHEN {cxx} > 0 AND {cyy} > 0 THEN {cxy} / sqrt({cxx} * {cyy}) END')} AS distance_correlation,
       {r6(D.div('ab', 'sqrt(aa * bb)'))} AS cosine_similarity FROM {tag}_g"""


def _raw_vec(spark, d):
    return VX.as_vector(V.emb_raw(spark, d), ["x1", "x2", "x3"])


RAW_VEC_SQL = "SELECT dataset, row_id, [x1, x2, x3] AS vec FROM raw"


# ---------------------------------------------------------------- I (S)

@register("i4_elbow_k", lambda: _elbow_sql())
def i4_elbow_k(spark, d):
    """I4: elbow k from an inertia curve (k = 1..9), reference rule (arg-min of
    the second difference + 2) and max-curvature rule."""
    curve = CL.bin_inertia_curve(V.samples(spark, d), ["dataset"], "x1", "x3", 9)
    curve = curve.withColumn("inertia", F.round("inertia", 2))
    a = CL.elbow_k(curve, ["dataset"], rule="reference").withColumnRenamed("elbow_k", "k_reference")
    b = CL.elbow_k(curve, ["dataset"], rule="max_curvature").withColumnRenamed("elbow_k", "k_max_curvature")
    return a.join(b, "dataset")


def _elbow_sql():
    from vantage.plans.queries_agg import _bin_curve_sql
    q = base("samples")
    q.add("curve", f"SELECT dataset, k, round(inertia, 2) AS inertia FROM ({_bin_curve_sql()}) c")
    q.add("d2", "SELECT dataset, k, lead(inertia, 2) OVER w - 2 * lead(inertia, 1) OVER w + inertia AS d2 "
                "FROM curve WINDOW w AS (PARTITION BY dataset ORDER BY k)")
    return q.sql("""SELECT dataset,
       CASE WHEN count(d2) > 0 THEN arg_min(k, (d2, k)) FILTER (WHERE d2 IS NOT NULL) + 1 ELSE 1 END AS k_reference,
       CASE WHEN count(d2) > 0 THEN arg_min(k, (-d2, k)) FILTER (WHERE d2 IS NOT NULL) + 1 ELSE 1 END AS k_max_curvature
       FROM d2 GROUP BY dataset""")


@register("i6_choose_k", lambda: base("raw").sql(f"""
SELECT dataset, CAST(least(greatest(2, least(10, count(DISTINCT (x1, x2, x3)))), least(count(*), {CAP})) AS INTEGER) AS k
FROM raw GROUP BY dataset"""))
def i6_choose_k(spark, d):
    """k = max(2, min(10, distinct rows)), capped by the sample size."""
    return CL.choose_k(V.emb_raw(spark, d), ["dataset"], ["x1", "x2", "x3"], cap=CAP)


def _i7_sql():
    q = base("samples")
    q.add("c", "SELECT dataset, cat1 || cat2 AS row_id, [avg(x1), avg(x2), avg(x3)] AS vec FROM samples GROUP BY dataset, cat1, cat2")
    return q.sql(f"SELECT dataset, i, j, {r6('dist')} AS dist, w FROM ({dist_pairs_sql('c', 'dataset', 'a.vec', 'b.vec')}) p")


@register("i7_center_distances", _i7_sql)
def i7_center_distances(spark, d):
    """Centre-to-centre distances of the four (cat1, cat2) cell centres."""
    c = RL.cell_profile(V.samples(spark, d)).select(
        "dataset", F.concat("cat1", "cat2").alias("cell"), F.array("x1_mean", "x2_mean", "x3_mean").alias("center"))
    return VX.center_distances(c, ["dataset"], "cell", "center")


def _i8_sql():
    q = base("raw")
    q.add("rv", first_rows_sql(f"({RAW_VEC_SQL})"))
    q.add("p", dist_pairs_sql("rv", "dataset", "a.vec", "b.vec"))
    return q.sql(f"SELECT dataset, sum(w) AS n_entries, {r6('sum(w * dist) / sum(w)')} AS mean_dist FROM p GROUP BY dataset")


@register("i8_distance_pairs", _i8_sql)
def i8_distance_pairs(spark, d):
    """I8: flattened row-distance matrix (both triangles + zero diagonal, as
    weights), first 300 rows: entries and mean distance per dataset."""
    p = VX.distance_pairs(_raw_vec(spark, d), ["dataset"], "row_id", "vec", cap=CAP)
    return p.groupBy("dataset").agg(F.sum("w").alias("n_entries"),
                                    (F.sum(F.col("w") * F.col("dist")) / F.sum("w")).alias("mean_dist"))


def _i12_ctes():
    q = base("raw", "emb")
    q.add("firstrows", first_rows_sql("(SELECT r.dataset, r.row_id FROM raw r SEMI JOIN (SELECT DISTINCT dataset, row_id FROM emb) e "
                                      "ON r.dataset = e.dataset AND r.row_id = e.row_id)"))
    q.add("rv", f"SELECT r.* FROM ({RAW_VEC_SQL}) r SEMI JOIN firstrows f ON r.dataset = f.dataset AND r.row_id = f.row_id")
    q.add("ev", "SELECT e.* FROM emb e SEMI JOIN firstrows f ON e.dataset = f.dataset AND e.row_id = f.row_id")
    q.add("rp", dist_pairs_sql("rv", "dataset", "a.vec", "b.vec"))
    q.add("ep", dist_pairs_sql("ev", "dataset, model", "a.embedding", "b.embedding"))
    q.add("pj", "SELECT e.dataset, e.model, e.i, e.j, e.dist AS d_emb, e.w, r.dist AS d_raw FROM ep e "
                "JOIN rp r ON e.dataset = r.dataset AND e.i = r.i AND e.j = r.j")
    return q


@register("i12_distance_similarity", lambda: (lambda q: q.sql(matrix_similarity_sql(q, "pj", "dataset, model", "d_raw", "d_emb", "w", "ms")))(_i12_ctes()))
def i12_distance_similarity(spark, d):
    """Row-geometry similarity per (dataset, model): Spearman and cosine of
    the raw and embedding row-distance matrices (first 300 rows)."""
    return VX.distance_similarity(V.emb_raw(spark, d), V.emb_long(spark, d), ["x1", "x2", "x3"], cap=CAP)


@register("i11_pair_cosine", lambda: (lambda q: q.sql(f"""SELECT dataset, model,
    {r6(D.div('sum(w * d_raw * d_emb)', 'sqrt(sum(w * d_raw * d_raw) * sum(w * d_emb * d_emb))'))} AS cosine
    FROM pj GROUP BY dataset, model"""))(_i12_ctes()))
def i11_pair_cosine(spark, d):
    """Cosine of the two flattened distance matrices."""
    rv = _raw_vec(spark, d)
    emb = V.emb_long(spark, d)
    first = RL.head_per_group(rv.select("dataset", "row_id").join(emb.select("dataset", "row_id").distinct(),
                                                                  ["dataset", "row_id"], "left_semi"),
                              ["dataset"], ["row_id"], CAP)
    rp = VX.distance_pairs(rv.join(first, ["dataset", "row_id"], "left_semi"), ["dataset"], "row_id", "vec", cap=None)
    ep = VX.distance_pairs(emb.join(first, ["dataset", "row_id"], "left_semi"), ["dataset", "model"], "row_id",
                           "embedding", cap=None)
    j = ep.select("dataset", "model", "i", "j", F.col("dist").alias("d_emb"), "w").join(
        rp.select("dataset", "i", "j", F.col("dist").alias("d_raw")), ["dataset", "i", "j"])
    return VX.pair_cosine(j, ["dataset", "model"], "d_raw", "d_emb", "w")


def _i14_sql():
    q = base("raw")
    q.add("rv", first_rows_sql("(SELECT dataset, row_id, [x2, x3] AS vec, x1 > 0 AS lab FROM raw)"))
    q.add("pd", """SELECT a.dataset, a.row_id AS i, a.lab AS li, b.lab AS lj,
       sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d
       FROM rv a JOIN rv b ON a.dataset = b.dataset AND a.row_id <> b.row_id""")
    q.add("per", "SELECT dataset, i, li, lj, avg(d) AS md FROM pd GROUP BY ALL")
    q.add("sz", "SELECT dataset, lab AS li, count(*) AS sz FROM rv GROUP BY ALL")
    q.add("s", """SELECT p.dataset, p.i, p.li, max(CASE WHEN p.li = p.lj THEN md END) AS a,
       min(CASE WHEN p.li <> p.lj THEN md END) AS b FROM per p GROUP BY ALL""")
    sil = (f"CASE WHEN sz <= 1 THEN 0.0 ELSE {D.div('b - coalesce(a, 0.0)', 'greatest(coalesce(a, 0.0), b)')} END")
    return q.sql(f"""SELECT s.dataset, {r6(f'CASE WHEN count(b) > 0 THEN avg({sil}) END')} AS silhouette, count(*) AS n
       FROM s JOIN sz ON s.dataset = sz.dataset AND s.li = sz.li GROUP BY s.dataset""")


@register("i14_silhouette", _i14_sql)
def i14_silhouette(spark, d):
    """Mean silhouette (exact Euclidean) of a given labelling, first 300 rows."""
    r = V.emb_raw(spark, d).select("dataset", "row_id", F.array("x2", "x3").alias("vec"), (F.col("x1") > 0).alias("lab"))
    return VX.silhouette(r, ["dataset"], "row_id", "vec", "lab", cap=CAP)


def _i14sq_sql():
    q = base("raw")
    q.add("rv", "SELECT dataset, x2 AS v1, x3 AS v2, x2 * x2 + x3 * x3 AS sq, x1 > 0 AS lab FROM raw")
    q.add("cl", "SELECT dataset, lab, count(*) AS n, avg(sq) AS m2, avg(v1) AS mu1, avg(v2) AS mu2 FROM rv GROUP BY ALL")
    q.add("d", """SELECT r.dataset, r.lab, c.lab AS clab, c.n, r.sq - 2.0 * (r.v1 * c.mu1 + r.v2 * c.mu2) + c.m2 AS md,
       r.v1, r.v2, r.sq FROM rv r JOIN cl c ON r.dataset = c.dataset""")
    q.add("s", """SELECT dataset, v1, v2, sq, lab,
       max(CASE WHEN lab = clab AND n > 1 THEN md * n / (n - 1) END) AS a,
       max(CASE WHEN lab = clab THEN n END) AS own_n,
       min(CASE WHEN lab <> clab THEN md END) AS b, count(*) AS k FROM d GROUP BY dataset, v1, v2, sq, lab""")
    s_expr = f"CASE WHEN own_n <= 1 THEN 0.0 ELSE {D.div('b - a', 'greatest(a, b)')} END"
    return q.sql(f"""SELECT dataset, {r6(f'CASE WHEN max(k) > 1 THEN avg({s_expr}) END')} AS silhouette_sq,
       count(*) AS n FROM s GROUP BY dataset""")


@register("i14_silhouette_sq", _i14sq_sql)
def i14_silhouette_sq(spark, d):
    """I14 over whole datasets: squared-Euclidean silhouette from per-cluster sums (no pairs)."""
    r = V.emb_raw(spark, d).select("dataset", F.array("x2", "x3").alias("vec"), (F.col("x1") > 0).alias("lab"))
    return VX.silhouette_sq(r, ["dataset"], "vec", "lab")


def _i8sq_sql():
    q = base("raw")
    return q.sql(f"""SELECT a.dataset, count(DISTINCT a.row_id) AS n,
       {r6('avg(pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2) + pow(a.x3 - b.x3, 2))')} AS mean_sq_dist
       FROM raw a JOIN raw b ON a.dataset = b.dataset GROUP BY a.dataset""")


@register("i8_mean_sq_distance", _i8sq_sql)
def i8_mean_sq_distance(spark, d):
    """I8 / D7 over whole datasets: mean squared row distance from variances (the twin forms all pairs)."""
    return VX.mean_sq_distance(V.emb_raw(spark, d), ["dataset"], ["x1", "x2", "x3"])


@register("i8_distance_pairs_whole")
def i8_distance_pairs_whole(spark, d):
    """I8 over whole datasets: entries and mean distance of the full row-distance matrix, summed per tile."""
    m = VX.pair_moments(_raw_vec(spark, d), ["dataset"], "row_id", "vec")
    entries = F.col("n").cast("double") * F.col("n")
    return m.select("dataset", entries.alias("n_entries"), (2.0 * F.col("sum_a") / entries).alias("mean_dist"))


@register("d7_pairwise_whole")
def d7_pairwise_whole(spark, d):
    """D7 over whole datasets: row pairs i < j and their mean distance, summed per tile."""
    m = VX.pair_moments(_raw_vec(spark, d), ["dataset"], "row_id", "vec").where("n_pairs > 0")
    return m.select("dataset", "n_pairs", (F.col("sum_a") / F.col("n_pairs")).alias("mean_dist"))


@register("i11_pair_cosine_whole")
def i11_pair_cosine_whole(spark, d):
    """I11 over whole datasets: cosine of the two flattened distance matrices of all rows, summed per tile."""
    return VX.pair_cosine_whole(V.emb_raw(spark, d), V.emb_long(spark, d), ["x1", "x2", "x3"]).withColumnRenamed("cosine_similarity", "cosine")


def _cka_sql():
    q = base("raw", "emb")
    q.add("xl", " UNION ALL ".join(f"SELECT dataset, row_id, {i} AS i, x{i} AS v FROM raw" for i in (1, 2, 3)))
    q.add("yl", "SELECT dataset, model, row_id, j, embedding[j] AS v FROM emb, unnest(range(1, 17)) AS u(j)")
    q.add("cxy", "SELECT y.dataset, y.model, x.i, y.j, covar_pop(x.v, y.v) AS c FROM yl y JOIN xl x ON x.dataset = y.dataset AND x.row_id = y.row_id GROUP BY ALL")
    q.add("cyy", "SELECT a.dataset, a.model, a.j, b.j AS k, covar_pop(a.v, b.v) AS c FROM yl a JOIN yl b ON a.dataset = b.dataset AND a.model = b.model AND a.row_id = b.row_id GROUP BY ALL")
    q.add("cxx", "SELECT e.dataset, e.model, a.i, b.i AS k, covar_pop(a.v, b.v) AS c FROM emb e JOIN xl a ON a.dataset = e.dataset AND a.row_id = e.row_id JOIN xl b ON b.dataset = e.dataset AND b.row_id = e.row_id GROUP BY ALL")
    for t in ("cxy", "cxx", "cyy"):
        q.add(f"{t}s", f"SELECT dataset, model, sum(c * c) AS s FROM {t} GROUP BY ALL")
    q.add("nn", "SELECT dataset, model, count(*) AS n FROM emb GROUP BY ALL")
    return q.sql(f"""SELECT n.dataset, n.model, n.n, {r6(D.div('a.s', 'sqrt(b.s * c.s)'))} AS cka FROM nn n JOIN cxys a USING (dataset, model)
       JOIN cxxs b USING (dataset, model) JOIN cyys c USING (dataset, model)""")


@register("i12_linear_cka", _cka_sql)
def i12_linear_cka(spark, d):
    """I12 over whole datasets: linear CKA of raw features and embeddings per (dataset, model)."""
    return VX.linear_cka(V.emb_raw(spark, d), V.emb_long(spark, d), ["x1", "x2", "x3"], 16)


# ---------------------------------------------------------------- I (P: iterative)

@register("i3_kmeans")
def i3_kmeans(spark, d):
    """Grouped K-means (k = 4, 10 restarts) per (dataset, model) on the embeddings."""
    a, c, cost = CL.kmeans(V.emb_long(spark, d), ["dataset", "model"], "row_id", "embedding", 4)
    sizes = a.groupBy("dataset", "model").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("k"))
    return sizes.join(cost, ["dataset", "model"])


@register("i2_pca")
def i2_pca(spark, d):
    """Grouped PCA to 2 components per (dataset, model)."""
    scores, comp = CL.pca(V.emb_long(spark, d), ["dataset", "model"], "row_id", "embedding", V.EMB_WIDTH, 2)
    s = scores.groupBy("dataset", "model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("scores")[0]).alias("pc1_mean"),
                                               F.var_samp(F.col("scores")[0]).alias("pc1_var"))
    return s.join(comp.select("dataset", "model", F.col("explained")[0].alias("explained_1")), ["dataset", "model"])


@register("i5_assign_clusters")
def i5_assign_clusters(spark, d):
    """cluster_<model> label columns beside the raw rows (k = 2)."""
    out = CL.assign_clusters(V.emb_raw(spark, d), V.emb_long(spark, d), V.EMB_MODELS, k=2)
    cols = [c for c in out.columns if c.startswith("cluster_")]
    return out.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"{c}_share") for c in cols])


@register("i9_cluster_similarity")
def i9_cluster_similarity(spark, d):
    """Cluster-geometry similarity (k = 5) over all rows."""
    return CL.cluster_similarity(V.emb_raw(spark, d), V.emb_long(spark, d), ["x1", "x2", "x3"], k=5)


@register("i10_cluster_similarity_reduced")
def i10_cluster_similarity_reduced(spark, d):
    """As I9 with mean imputation, 2-D PCA of the embeddings and a k
    of its own (2 to 10, by distinct rows) for each dataset."""
    raw = J.impute(V.emb_raw(spark, d), ["dataset"], ["x1", "x2", "x3"], "mean")
    emb = V.emb_long(spark, d)
    scores, _ = CL.pca(emb, ["dataset", "model"], "row_id", "embedding", 16, 2)
    emb2 = scores.withColumnRenamed("scores", "embedding")
    k = CL.choose_k(raw, ["dataset"], ["x1", "x2", "x3"])
    return CL.cluster_similarity(raw, emb2, ["x1", "x2", "x3"], k=k)


def audit_choice(spark, d, cap=None):
    """Best dataset per model by cosine over all its rows (``cap``: over its first ones, 300 in the reference)."""
    raw, emb, cols = V.emb_raw(spark, d), V.emb_long(spark, d), ["x1", "x2", "x3"]
    sim = VX.pair_cosine_whole(raw, emb, cols) if cap is None else VX.distance_similarity(raw, emb, cols, cap=cap)
    return RL.best_row(sim, ["model"], "cosine_similarity", ["dataset"]).select("model", "dataset")


@register("i13_audit_table")
def i13_audit_table(spark, d, cap=None):
    """Best dataset per model by cosine (over all rows unless ``cap``
    is given) with every row's 2-D coordinates and 4-cluster label, raw and
    embedded side."""
    best = R.materialize(audit_choice(spark, d, cap))
    return CL.audit_rows(V.emb_raw(spark, d), V.emb_long(spark, d), best, ["x1", "x2", "x3"])


@register("i4_elbow_kmeans")
def i4_elbow_kmeans(spark, d):
    """I4: elbow of the K-means inertia (k = 1..9, 10 restarts) per (dataset, model), on the plane of the first two components."""
    return CL.elbows(V.emb_long(spark, d), ["dataset", "model"], "row_id", "embedding")


@register("i15_cluster_count_summary")
def i15_cluster_count_summary(spark, d):
    """Elbow k (k = 1..9) of each dataset's reduced embeddings, summarised per (model, equation) beside the original 4 clusters."""
    emb = V.emb_long(spark, d)
    kinds = emb.select("dataset").distinct().select("dataset", V.equation_of(F.regexp_extract("dataset", r"(\d+)$", 1).cast("bigint")).alias("equation"))
    return CL.cluster_count_summary(emb, kinds)


@register("i1_embed_texts")
def i1_embed_texts(spark, d):
    """Text -> vector in batches (tokenise, hashed term counts, IDF,
    L2 norm), the re-aimed row embedding."""
    from vantage.operators.text import embed_texts
    e = embed_texts(V.table(spark, d, "documents"), "text", dim=256)
    return e.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("norm").alias("mean_norm"),
                                 F.avg("nnz").alias("mean_nnz"))


# ---------------------------------------------------------------- J

def _nulls(df):
    """Inject NULLs (every row whose order key is a multiple of 7)."""
    return df.withColumn("x1", F.when(F.col("ok") % 7 != 0, F.col("x1"))).withColumn(
        "cat1", F.when(F.col("ok") % 5 != 0, F.col("cat1")))


def _j1_sql():
    q = base("samples")
    q.add("s", "SELECT *, CASE WHEN ok % 7 <> 0 THEN x1 END AS x1n FROM samples")
    return q.sql(f"""SELECT s.dataset, {r6('avg(coalesce(x1n, m))')} AS x1_mean_filled,
       {r6('avg(coalesce(x1n, md))')} AS x1_median_filled
       FROM s JOIN (SELECT dataset, avg(x1n) AS m, median(x1n) AS md FROM s GROUP BY dataset) g ON s.dataset = g.dataset
       GROUP BY s.dataset""")


@register("j1_impute", _j1_sql)
def j1_impute(spark, d):
    """Mean and median imputation per dataset (NULLs injected in x1)."""
    s = _nulls(V.samples(spark, d)).select("dataset", "x1")
    a = J.impute(s, ["dataset"], ["x1"], "mean").groupBy("dataset").agg(F.avg("x1").alias("x1_mean_filled"))
    b = J.impute(s, ["dataset"], ["x1"], "median").groupBy("dataset").agg(F.avg("x1").alias("x1_median_filled"))
    return a.join(b, "dataset")


def _j2_sql():
    q = base("samples")
    q.add("s", "SELECT *, CASE WHEN ok % 5 <> 0 THEN cat1 END AS c FROM samples")
    q.add("m", """SELECT dataset, c AS mode FROM (SELECT dataset, c, row_number() OVER (PARTITION BY dataset
       ORDER BY count(*) DESC, c) AS rn FROM s WHERE c IS NOT NULL GROUP BY dataset, c) t WHERE rn = 1""")
    return q.sql("""SELECT s.dataset, coalesce(s.c, m.mode) AS cat1, count(*) AS n FROM s JOIN m ON s.dataset = m.dataset
       GROUP BY 1, 2""")


@register("j2_impute_mode", _j2_sql)
def j2_impute_mode(spark, d):
    """Fill missing categories with the most frequent value (smallest on ties)."""
    s = _nulls(V.samples(spark, d)).select("dataset", "cat1")
    return J.impute_mode(s, ["dataset"], ["cat1"]).groupBy("dataset", "cat1").agg(F.count(F.lit(1)).alias("n"))


@register("j3_one_hot", lambda: base("samples").sql("""
SELECT dataset, sum(CASE WHEN cat1 = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cat1_A, sum(CASE WHEN cat1 = 'B' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cat1_B,
       sum(CASE WHEN cat2 = 'X' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cat2_X, sum(CASE WHEN cat2 = 'Y' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cat2_Y
FROM samples GROUP BY dataset"""))
def j3_one_hot(spark, d):
    """One-hot indicators (unseen / NULL -> all zeros)."""
    s = J.one_hot(J.one_hot(V.samples(spark, d), "cat1", ["A", "B"]), "cat2", ["X", "Y"])
    return s.groupBy("dataset").agg(*[F.sum(c).alias(c) for c in ["cat1_A", "cat1_B", "cat2_X", "cat2_Y"]])


ZB = "avg(CASE WHEN cat1 = 'B' THEN (x1 - m) / sd END)"


@register("j4_standardize", lambda: base("samples").sql(f"""
SELECT s.dataset, {r6(ZB)} AS z_b_mean,
       {r6('sum(pow((x1 - m) / sd, 2))')} AS z_ss
FROM samples s JOIN (SELECT dataset, avg(x1) AS m, stddev_pop(x1) AS sd FROM samples GROUP BY dataset) g
  ON s.dataset = g.dataset GROUP BY s.dataset"""))
def j4_standardize(spark, d):
    """(x - mean) / population std per dataset."""
    z = J.standardize(V.samples(spark, d), ["dataset"], ["x1"])
    return z.groupBy("dataset").agg(F.avg(F.when(F.col("cat1") == "B", F.col("x1"))).alias("z_b_mean"),
                                    F.sum(F.pow("x1", 2)).alias("z_ss"))


@register("j6_split", lambda: base("samples").sql(f"""
SELECT dataset, {D.split_sql('row_key')} AS is_test, count(*) AS n FROM samples GROUP BY 1, 2"""))
def j6_split(spark, d):
    """Deterministic 70/30 train/test split by row-key hash."""
    return J.split(V.samples(spark, d), "row_key").groupBy("dataset", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("j7_stratified_split", lambda: base("samples").sql("""
SELECT dataset, cat1, is_test, count(*) AS n FROM (
  SELECT dataset, cat1, count(*) OVER (PARTITION BY dataset, cat1) >= 2 AND
         row_number() OVER (PARTITION BY dataset, cat1 ORDER BY md5(concat_ws('|', row_key, '42')), row_key)
           <= ceil(count(*) OVER (PARTITION BY dataset, cat1) * 0.3) AS is_test FROM samples) t GROUP BY 1, 2, 3"""))
def j7_stratified_split(spark, d):
    """Stratified split (30% of each (dataset, cat1) stratum to test)."""
    s = J.stratified_split(V.samples(spark, d), ["dataset"], "cat1", "row_key")
    return s.groupBy("dataset", "cat1", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("j5_feature_matrix")
def j5_feature_matrix(spark, d):
    """Numeric + categorical branches into one vector (impute, one-hot, assemble): rows, width and the mean of each feature per dataset."""
    from vantage.operators.features import feature_matrix, feature_names
    s = _nulls(V.samples(spark, d))
    numeric, categorical = ["x1", "x2"], {"cat1": ["A", "B"], "cat2": ["X", "Y"]}
    fm = feature_matrix(s, ["dataset"], numeric, categorical)
    means = [F.avg(F.col("features")[i]).alias(f"{c}_mean") for i, c in enumerate(feature_names(numeric, categorical))]
    return fm.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width"), *means)


@register("j8_smote")
def j8_smote(spark, d):
    """SMOTE oversampling of each class to the majority size (docs, by source)."""
    from vantage.operators.features import smote
    docs = V.docs(spark, d).select("doc_id", "source", "quality",
                                   F.array(F.log1p(F.col("n_chars").cast("double")),
                                           F.length("text").cast("double") / 1000.0).alias("vec"))
    out = smote(docs, ["source"], "doc_id", "vec", "quality", k=5)
    return out.groupBy("source", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("synthetic").cast("int")).alias("n_synthetic"))


# ---------------------------------------------------------------- K

def _design_sql(q):
    q.add("sd", f"""SELECT *, CASE WHEN cat1 = 'B' THEN 1.0 ELSE 0.0 END AS cat1_B, CASE WHEN cat2 = 'Y' THEN 1.0 ELSE 0.0 END AS cat2_Y,
       {D.split_sql('row_key')} AS is_test FROM samples""")


def _k1_sql():
    q = base("samples")
    _design_sql(q)
    q.add("km", D.moments_sql("sd", ["dataset"], "x3", R.ASSISTED, "NOT is_test"))
    c = D.solve_sql(q, "km", ["dataset"], [0, 1, 2, 3, 4], R.ASSISTED, "b_", tag="kg")
    return q.sql(f"SELECT dataset, n, {', '.join(f'{r6(f'b_{x}')} AS b_{x}' for x in ['intercept', *R.ASSISTED])} FROM {c}")


@register("k1_grouped_ols", _k1_sql)
def k1_grouped_ols(spark, d):
    """K1: OLS coefficients per dataset on the training rows (one aggregate)."""
    s = R.design(V.samples(spark, d))
    return K.grouped_ols(s, ["dataset"], "x3", R.ASSISTED, where=~F.col("is_test"))


def _k2_sql():
    q = base("samples")
    q.add("km", D.moments_sql("samples", ["dataset"], "x3", ["x1", "x2"]))
    c = D.solve_sql(q, "km", ["dataset"], [0, 1, 2], ["x1", "x2"], "b_", tag="kg")
    return q.sql(f"""SELECT s.dataset, {r6('avg(s.x3 - (b_intercept + b_x1 * s.x1 + b_x2 * s.x2))')} AS resid_mean,
       {r6('sqrt(avg(pow(s.x3 - (b_intercept + b_x1 * s.x1 + b_x2 * s.x2), 2)))')} AS resid_rms
       FROM samples s JOIN {c} c ON s.dataset = c.dataset GROUP BY s.dataset""")


@register("k2_ols_fit", _k2_sql)
def k2_ols_fit(spark, d):
    """K2: OLS with intercept, fitted values and residuals per row."""
    f = K.ols_fit(V.samples(spark, d), ["dataset"], "x3", ["x1", "x2"])
    return f.groupBy("dataset").agg(F.avg("resid").alias("resid_mean"), F.sqrt(F.avg(F.pow("resid", 2))).alias("resid_rms"))


# The linear model family compared by K8 (name -> features).
LINEAR_FAMILY = {"LinearX1": ["x1"], "LinearX1Cat1": ["x1", "cat1_B"], "LinearAll": R.ASSISTED}


def _k8_frame(spark, d):
    s = R.design(V.samples(spark, d))
    mom = K.cross_moments(s, ["dataset"], "x3", R.ASSISTED, where=~F.col("is_test"))
    idx = {"x1": 1, "cat1_B": 2, "x2": 3, "cat2_Y": 4}
    # all designs are solved in one projection chain over the same moments row
    moment_cols = [c for c in mom.columns if c.startswith(("s_", "sy_"))]
    coef, kept = mom, []
    for name, feats in LINEAR_FAMILY.items():
        coef = K.solve_moments(coef, ["dataset"], [0, *[idx[f] for f in feats]], feats, f"{name}_",
                               keep=[*moment_cols, *kept])
        kept += [f"{name}_{c}" for c in ["intercept", *feats]]
    coef = coef.select("dataset", *kept)
    test = s.where(F.col("is_test")).join(coef, "dataset")
    pred = test.select("dataset", F.col("x3").alias("y"),
                       *[K.linear_prediction(f"{n}_", f).alias(f"yhat_{n}") for n, f in LINEAR_FAMILY.items()])
    return R.regression_metrics_multi(pred, ["dataset"], "y", {n: f"yhat_{n}" for n in LINEAR_FAMILY})


def _k8_sql():
    q = base("samples")
    _design_sql(q)
    q.add("km", D.moments_sql("sd", ["dataset"], "x3", R.ASSISTED, "NOT is_test"))
    idx = {"x1": 1, "cat1_B": 2, "x2": 3, "cat2_Y": 4}
    names = []
    for n, feats in LINEAR_FAMILY.items():
        names.append((n, D.solve_sql(q, "km", ["dataset"], [0, *[idx[f] for f in feats]], feats, f"{n}_", tag=f"k{n}"), feats))
    joins = " ".join(f"JOIN {c} ON t.dataset = {c}.dataset" for _, c, _ in names)
    preds = ", ".join(f"{n}_intercept + " + " + ".join(f"{n}_{f} * t.{f}" for f in feats) + f" AS yhat_{n}"
                      for n, _, feats in names)
    q.add("pr", f"SELECT t.dataset, t.x3 AS y, {preds} FROM sd t {joins} WHERE t.is_test")
    parts = []
    for order, n in enumerate(LINEAR_FAMILY):
        parts.append(f"""SELECT dataset, '{n}' AS model, {order} AS ord, count(*) AS n,
           1.0 - {D.div(f'sum((y - yhat_{n}) * (y - yhat_{n}))', 'var_pop(y) * count(*)')} AS r2,
           sqrt(sum((y - yhat_{n}) * (y - yhat_{n})) / count(*)) AS rmse, avg(abs(y - yhat_{n})) AS mae FROM pr GROUP BY dataset""")
    q.add("met", " UNION ALL ".join(parts))
    return q.sql(f"""SELECT dataset, model AS best_model, n, {r6('r2')} AS r2, {r6('rmse')} AS rmse, {r6('mae')} AS mae FROM (
       SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY r2 DESC, ord) AS rn FROM met WHERE r2 IS NOT NULL) t WHERE rn = 1""")


@register("k8_best_linear_design", _k8_sql)
def k8_best_linear_design(spark, d):
    """K8 over linear designs: three designs of one linear model, the best by test R2 (first wins ties); ``k8_best_of_families`` has the model families."""
    m = _k8_frame(spark, d)
    order = F.create_map(*[x for i, n in enumerate(LINEAR_FAMILY) for x in (F.lit(n), F.lit(i))])
    m = m.withColumn("_ord", order[F.col("model")])
    best = K.best_by(m, ["dataset"], "r2", "_ord")
    return best.select("dataset", F.col("model").alias("best_model"), "n", "r2", "rmse", "mae")


@register("k10_regression_metrics", lambda: (lambda q: q.sql(f"""SELECT dataset, model, n, {r6('r2')} AS r2, {r6('rmse')} AS rmse,
    {r6('mae')} AS mae FROM pairs"""))(_pairs_q()))
def k10_regression_metrics(spark, d):
    """R2 (1 - SSE/SST), RMSE and MAE per (dataset, model) on test rows."""
    return R.regression_pairs(spark, d)


def _pairs_q():
    q = D.CTE()
    D.pairs_ctes(q)
    return q


def _auc_sql(by: str, label: str, score: str, src: str) -> str:
    return f"""SELECT {by}, n_pos, n_neg, {r6(f'CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rp - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END')} AS auc FROM (
  SELECT {by}, sum(CASE WHEN y = 1 THEN r ELSE 0.0 END) AS rp, count(CASE WHEN y = 1 THEN 1 END) AS n_pos,
         count(CASE WHEN y <> 1 THEN 1 END) AS n_neg FROM (
    SELECT {by}, CAST({label} AS INTEGER) AS y, {D.avg_rank_sql(by, score)} AS r FROM {src} WHERE {score} IS NOT NULL) a
  GROUP BY {by}) g"""


@register("k11_auc", lambda: _auc_sql("source", "quality", "sc",
                                      "(SELECT source, quality, ln(CAST(n_chars AS DOUBLE) + 1.0) AS sc FROM documents JOIN labels USING (doc_id))"))
def k11_auc(spark, d):
    """ROC AUC per source of a score (log length) against the quality label."""
    docs = V.docs(spark, d).withColumn("sc", F.log1p(F.col("n_chars").cast("double")))
    return K.auc(docs, ["source"], "quality", "sc")


def _k9_sql():
    src = """(SELECT source, quality, 'LenScore' AS model, 0 AS ord, ln(CAST(n_chars AS DOUBLE) + 1.0) AS sc FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT source, quality, 'ToxicScore', 1, CAST(1 - toxic AS DOUBLE) FROM documents JOIN labels USING (doc_id))"""
    a = _auc_sql("source, model, ord", "quality", "sc", src)
    return f"""SELECT source, model AS best_model, auc FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY auc DESC, ord) AS rn FROM ({a}) x WHERE auc IS NOT NULL) t WHERE rn = 1"""


@register("k9_best_scorer", _k9_sql)
def k9_best_scorer(spark, d):
    """K9 over ready scores: per source, the better of two by AUC (first wins ties); ``k9_classifier_chain`` fits classifiers."""
    docs = V.docs(spark, d)
    a = docs.select("source", "quality", F.lit("LenScore").alias("model"), F.lit(0).alias("ord"),
                    F.log1p(F.col("n_chars").cast("double")).alias("sc"))
    b = docs.select("source", "quality", F.lit("ToxicScore").alias("model"), F.lit(1).alias("ord"),
                    (1 - F.col("toxic")).cast("double").alias("sc"))
    au = K.auc(a.unionByName(b), ["source", "model", "ord"], "quality", "sc")
    au = au.withColumn("auc", F.round("auc", 6))
    best = K.best_by(au.select("source", "model", "ord", "auc"), ["source"], "auc", "ord")
    return best.select("source", F.col("model").alias("best_model"), "auc")


def _k12_sql():
    q = base("samples")
    _design_sql(q)
    q.add("km", D.moments_sql("sd", ["dataset"], "x3", R.ASSISTED, "NOT is_test"))
    c = D.solve_sql(q, "km", ["dataset"], [0, 1, 2, 3, 4], R.ASSISTED, "b_", tag="kg")
    q.add("mn", "SELECT dataset, " + ", ".join(f"avg({x}) AS m_{x}" for x in R.ASSISTED) + " FROM sd GROUP BY dataset")
    q.add("att", "SELECT s.dataset, " + ", ".join(f"avg(abs(b_{x} * (s.{x} - m_{x}))) AS {x}" for x in R.ASSISTED) +
          f" FROM sd s JOIN {c} c ON s.dataset = c.dataset JOIN mn ON s.dataset = mn.dataset GROUP BY s.dataset")
    q.add("lng", " UNION ALL ".join(f"SELECT dataset, '{x}' AS feature, {x} AS importance FROM att" for x in R.ASSISTED))
    return q.sql("""SELECT dataset, string_agg(feature, ', ' ORDER BY rn) AS top_features FROM (
       SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY importance DESC, feature) AS rn FROM lng) t
       WHERE rn <= 5 GROUP BY dataset""")


@register("k12_top_features", _k12_sql)
def k12_top_features(spark, d):
    """K12 (+ G3): mean |linear contribution| per encoded feature, top 5 per dataset."""
    s = R.design(V.samples(spark, d))
    coef = K.grouped_ols(s, ["dataset"], "x3", R.ASSISTED, where=~F.col("is_test")).drop("n")
    att = K.linear_attribution(s, coef, ["dataset"], R.ASSISTED)
    return K.top_features(att, ["dataset"], 5)


@register("g3_top5_features", _k12_sql)
def g3_top5_features(spark, d):
    """Top-5 features by mean absolute attribution (row_number per dataset)."""
    return k12_top_features(spark, d)


def _k13_sql():
    q = base("samples")
    _design_sql(q)
    q.add("km", D.moments_sql("sd", ["dataset"], "x3", R.ASSISTED, "NOT is_test"))
    q.add("eq", f"""SELECT DISTINCT s.dataset, list_filter({_chosen_sql(REQUESTED)}, lambda f: list_contains(['x1', 'x2', 'x3', 'cat1', 'cat2'], f) AND f <> 'x3') AS lst
       FROM samples s""")
    use = {i: f"list_contains(lst, '{f.split('_')[0]}')" for i, f in enumerate(R.ASSISTED, 1)}
    cols = [f"CASE WHEN {use[i]} THEN sy_{i} ELSE 0.0 END AS sy_{i}" for i in use]
    cols += [f"CASE WHEN {use.get(i, 'TRUE')} AND {use[j]} THEN s_{i}_{j} ELSE 0.0 END AS s_{i}_{j}" for i in (0, *use) for j in use if j >= i]
    q.add("kmask", f"SELECT km.dataset, n, lst, s_0_0, sy_0, {', '.join(cols)} FROM km JOIN eq ON km.dataset = eq.dataset")
    c = D.solve_sql(q, "kmask", ["dataset"], [0, 1, 2, 3, 4], R.ASSISTED, "b_", keep=["lst"], tag="kg")
    terms = [f"CASE WHEN {use[i]} THEN printf('%.3f*{f}', b_{f}) END" for i, f in sorted(enumerate(R.ASSISTED, 1), key=lambda x: _K13_ORDER.index(x[1]))]
    q.add("pr", f"SELECT t.dataset, t.x3 AS y, b_intercept + {' + '.join(f'b_{f} * t.{f}' for f in R.ASSISTED)} AS yhat FROM sd t JOIN {c} c ON t.dataset = c.dataset WHERE t.is_test")
    q.add("met", f"""SELECT dataset, count(*) AS n, 1.0 - {D.div('sum((y - yhat) * (y - yhat))', 'var_pop(y) * count(*)')} AS r2,
       sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae FROM pr GROUP BY dataset""")
    return q.sql(f"""SELECT c.dataset, 'x3 = ' || concat_ws(' + ', printf('%.3f', b_intercept), {', '.join(terms)}) AS equation,
       met.n, {r6('r2')} AS r2, {r6('rmse')} AS rmse, {r6('mae')} AS mae FROM {c} c JOIN met ON c.dataset = met.dataset""")


_K13_ORDER = ["x1", "x2", "cat1_B", "cat2_Y"]


@register("k13_assisted_regression", _k13_sql)
def k13_assisted_regression(spark, d):
    """Assisted regression fitted on each dataset's requested (usable)
    features alone: equation of that fit and its test metrics.  All datasets
    are solved together, the features left out as zero rows of the moments."""
    s = R.design(V.samples(spark, d))
    avail = F.array(*[F.lit(c) for c in ["x1", "x2", "x3", "cat1", "cat2"]])
    lists = V.samples(spark, d).select("dataset", "equation").distinct().select(
        "dataset", F.filter(_chosen_col(REQUESTED), lambda f: F.array_contains(avail, f) & (f != "x3")).alias("lst"))
    use = {f: F.array_contains("lst", f.split("_")[0]) for f in R.ASSISTED}
    mom = K.cross_moments(s, ["dataset"], "x3", R.ASSISTED, where=~F.col("is_test")).join(lists, "dataset")
    coef = K.solve_moments(K.mask_moments(mom, list(use.values())), ["dataset"], [0, 1, 2, 3, 4], R.ASSISTED, "b_", keep=["lst"]).drop("n")
    pred = s.where(F.col("is_test")).join(coef, "dataset").select("dataset", F.col("x3").alias("y"), K.linear_prediction("b_", R.ASSISTED).alias("yhat"))
    terms = [F.when(use[f], F.format_string(f"%.3f*{f}", F.col(f"b_{f}"))) for f in _K13_ORDER]
    eq = F.concat(F.lit("x3 = "), F.concat_ws(" + ", F.format_string("%.3f", F.col("b_intercept")), *terms))
    return coef.select("dataset", eq.alias("equation")).join(K.regression_metrics(pred, ["dataset"]), "dataset")


@register("k14_inverse_fit")
def k14_inverse_fit(spark, d):
    """Fit SVR = a / (categories + b) by Gauss-Newton over all datasets."""
    meta = V.dataset_meta(spark, d)
    return K.inverse_fit(meta, "num_categorical_vars", "subject_variable_ratio")


@register("m6_complexity_frontier")
def m6_complexity_frontier(spark, d):
    """M6: inverse fit + a 100-point curve over the observed category range."""
    meta = V.dataset_meta(spark, d)
    p = K.inverse_fit(meta, "num_categorical_vars", "subject_variable_ratio")
    ext = RL.extent(meta, "num_categorical_vars")
    grid = RL.attach(ext, p).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(99))))
    x = F.col("min") + (F.col("max") - F.col("min")) * F.col("i") / 99.0
    return grid.select("i", x.alias("x"), (F.col("a") / (x + F.col("b"))).alias("y_fit"), "converged")
