"""Registered queries for E (aggregates), F (windows), G (sort/top-k), H (sets)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.functions import expr as B
from vantage.operators import relational as RL
from vantage.operators import stats as ST
from vantage.plans import duck as D
from vantage.plans import reports as R
from vantage.plans.catalog import register
from vantage.plans.queries_base import WIDE_PAIRS_SQL, base, wide_pairs
from vantage.sources import testdata as V

r6 = D.r6
FT_SQL = "nullif(regexp_extract(dataset, '_(linear|exponential|quadratic|cubic)', 1), '')"


def scored(spark, d):
    s = V.scores(spark, d)
    return s.withColumn("function_type", B.function_type("dataset"))


def ci_sql_cols(n: str, mean: str, sd: str, p: str = "") -> str:
    """DuckDB twin of ``stats.ci_columns`` (rounded)."""
    sd_ = f"(CASE WHEN {n} > 1 THEN {sd} END)"
    sem = f"({sd_} / sqrt({n}))"
    half = f"(CASE WHEN {n} > 1 THEN {sem} * {D.t_ppf(0.975, f'{n} - 1')} END)"
    return ", ".join([f"{n} AS {p}n", f"{r6(mean)} AS {p}mean", f"{r6(sd_)} AS {p}std", f"{r6(sem)} AS {p}sem",
                      f"{r6(half)} AS {p}ci", f"{r6(f'{mean} - {half}')} AS {p}ci_low",
                      f"{r6(f'{mean} + {half}')} AS {p}ci_high"])


# ---------------------------------------------------------------- E

@register("e1_summarize", lambda: base("scores").sql(f"""
SELECT model, {r6('avg(distance_correlation)')} AS distance_correlation_mean,
       {r6('stddev_samp(distance_correlation)')} AS distance_correlation_std,
       {r6('avg(cosine_similarity)')} AS cosine_similarity_mean,
       {r6('stddev_samp(cosine_similarity)')} AS cosine_similarity_std
FROM scores WHERE model IS NOT NULL GROUP BY model"""))
def e1_summarize(spark, d):
    """Grouped mean and std of both similarity scores per model (T5)."""
    return ST.summarize(V.scores(spark, d), ["model"], ["distance_correlation", "cosine_similarity"])


@register("e2_mean_sem", lambda: base("scores").sql(f"""
SELECT {FT_SQL} AS function_type, model, {r6('avg(distance_correlation)')} AS distance_correlation_mean,
       {r6('stddev_samp(distance_correlation) / sqrt(count(distance_correlation))')} AS distance_correlation_sem
FROM scores WHERE {FT_SQL} IS NOT NULL GROUP BY 1, 2"""))
def e2_mean_sem(spark, d):
    """Grouped mean and SEM by function type and model."""
    return ST.summarize(scored(spark, d), ["function_type", "model"], ["distance_correlation"], ["mean", "sem"])


@register("e3_summarize_ci", lambda: base("scores").sql(f"""
SELECT model, function_type, {ci_sql_cols('n', 'm', 's')} FROM (
  SELECT model, {FT_SQL} AS function_type, count(cosine_similarity) AS n, avg(cosine_similarity) AS m,
         stddev_samp(cosine_similarity) AS s FROM scores GROUP BY 1, 2) g"""))
def e3_summarize_ci(spark, d):
    """Mean, std, count, SEM and the Student-t 95% CI per model and function type."""
    return ST.summarize_ci(scored(spark, d), ["model", "function_type"], "cosine_similarity")


@register("e4_mean_ci", lambda: base("pairs").sql(f"""
SELECT model, {ci_sql_cols('n', 'm', 's')} FROM (
  SELECT model, count(r2) AS n, avg(r2) AS m, stddev_samp(r2) AS s FROM pairs GROUP BY model) g"""))
def e4_mean_ci(spark, d):
    """Whole-table mean +- 95% CI of R2 for each side of the pair."""
    return ST.summarize_ci(R.regression_pairs(spark, d), ["model"], "r2")


@register("e5_best_score", lambda: base("scores").sql(f"""
SELECT dataset, {r6('max(auc)')} AS auc FROM scores GROUP BY dataset"""))
def e5_best_score(spark, d):
    """E5: best (max) AUC per dataset over models and runs."""
    return RL.best_score(V.scores(spark, d), ["dataset"], "auc")


@register("e6_best_row", lambda: base("scores").sql(f"""
SELECT dataset, model, {r6('auc')} AS auc, event_id FROM (
  SELECT dataset, model, auc, event_id,
         row_number() OVER (PARTITION BY dataset ORDER BY auc DESC NULLS LAST, model, event_id) AS rn FROM scores) t
WHERE rn = 1"""))
def e6_best_row(spark, d):
    """The whole best row per dataset (ties: model, then event id)."""
    s = V.scores(spark, d).select("dataset", "model", "auc", "event_id")
    return RL.best_row(s, ["dataset"], "auc", ["model", "event_id"])


@register("e7_n_distinct", lambda: base("samples").sql("""
SELECT dataset, count(DISTINCT (cat1, cat2)) AS n_cells, count(DISTINCT x1) AS n_x1 FROM samples GROUP BY dataset"""))
def e7_n_distinct(spark, d):
    """Distinct category cells and distinct x1 values per dataset."""
    s = V.samples(spark, d)
    a = RL.n_distinct(s, ["dataset"], ["cat1", "cat2"]).withColumnRenamed("n_distinct", "n_cells")
    b = RL.n_distinct(s, ["dataset"], ["x1"]).withColumnRenamed("n_distinct", "n_x1")
    return a.join(b, "dataset")


@register("e8_class_balance", lambda: """
SELECT source, count(*) AS n_classes, min(c) AS min_class, max(c) AS max_class FROM (
  SELECT source, quality, count(*) AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) t GROUP BY source""")
def e8_class_balance(spark, d):
    """Class counts and the smallest class per group."""
    return RL.class_balance(V.docs(spark, d), ["source"], "quality")


@register("e9_win_rate", lambda: base("pairs").sql(f"""
SELECT {r6('avg(CAST(r2_assisted > r2_unassisted AS DOUBLE)) * 100.0')} AS win_rate, count(*) AS n
FROM ({WIDE_PAIRS_SQL}) w"""))
def e9_win_rate(spark, d):
    """Percent of datasets where the assisted model has the higher R2."""
    w = wide_pairs(spark, d).withColumn("better", F.col("r2_assisted") > F.col("r2_unassisted"))
    return RL.win_rate(w, "better")


def _box_sql(src: str, by: str, metric: str) -> str:
    return f"""
SELECT q.{by}, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3, n,
       {r6('whisker_low')} AS whisker_low, {r6('whisker_high')} AS whisker_high, n_outliers FROM (
  SELECT {by}, quantile_cont({metric}, 0.25) AS q1, quantile_cont({metric}, 0.5) AS median,
         quantile_cont({metric}, 0.75) AS q3, count({metric}) AS n FROM {src} WHERE {metric} IS NOT NULL GROUP BY {by}) q
JOIN (
  SELECT s.{by},
         min(CASE WHEN v >= lo AND v <= hi THEN v END) AS whisker_low,
         max(CASE WHEN v >= lo AND v <= hi THEN v END) AS whisker_high,
         count(CASE WHEN NOT (v >= lo AND v <= hi) THEN 1 END) AS n_outliers
  FROM (SELECT {by}, {metric} AS v FROM {src} WHERE {metric} IS NOT NULL) s JOIN (
    SELECT {by}, quantile_cont({metric}, 0.25) - 1.5 * (quantile_cont({metric}, 0.75) - quantile_cont({metric}, 0.25)) AS lo,
           quantile_cont({metric}, 0.75) + 1.5 * (quantile_cont({metric}, 0.75) - quantile_cont({metric}, 0.25)) AS hi
    FROM {src} WHERE {metric} IS NOT NULL GROUP BY {by}) b ON s.{by} = b.{by} GROUP BY s.{by}) w ON q.{by} = w.{by}"""


@register("e10_box_stats", lambda: base("scores").sql(_box_sql("scores", "model", "distance_correlation")))
def e10_box_stats(spark, d):
    """Box statistics of the distance correlation per model."""
    return RL.box_stats(V.scores(spark, d), ["model"], "distance_correlation", outliers=True)


@register("e11_extent", lambda: base("meta").sql(f"""
SELECT {r6('min(subject_variable_ratio)')} AS min, {r6('max(subject_variable_ratio)')} AS max,
       count(subject_variable_ratio) AS n FROM meta"""))
def e11_extent(spark, d):
    """Global min / max / N (axes, grids and titles)."""
    return RL.extent(V.dataset_meta(spark, d), "subject_variable_ratio")


@register("e12_dataset_metadata", lambda: base("meta").sql(f"""
SELECT dataset, n_rows, n_cols, num_categorical_vars, {r6('subject_variable_ratio')} AS subject_variable_ratio
FROM meta"""))
def e12_dataset_metadata(spark, d):
    """Table metadata per dataset (rows, columns, categoricals, SVR)."""
    return V.dataset_meta(spark, d)


@register("e13_cell_profile", lambda: base("samples").sql(f"""
SELECT dataset, cat1, cat2, count(*) AS n, {r6('avg(x1)')} AS x1_mean, {r6('avg(x2)')} AS x2_mean,
       {r6('avg(x3)')} AS x3_mean FROM samples GROUP BY dataset, cat1, cat2"""))
def e13_cell_profile(spark, d):
    """The four (cat1, cat2) ground-truth cells per dataset."""
    return RL.cell_profile(V.samples(spark, d))


@register("e14_melt", lambda: base("pairs").sql(f"""
SELECT variable, count(*) AS n, {r6('avg(value)')} AS mean_value FROM (
  SELECT dataset, 'r2_unassisted' AS variable, r2_unassisted AS value FROM ({WIDE_PAIRS_SQL}) w
  UNION ALL SELECT dataset, 'r2_assisted', r2_assisted FROM ({WIDE_PAIRS_SQL}) w2) t GROUP BY variable"""))
def e14_melt(spark, d):
    """Wide -> long (one row per dataset and method)."""
    long = RL.melt(wide_pairs(spark, d), ["dataset"], ["r2_unassisted", "r2_assisted"])
    return long.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


@register("e15_keys", lambda: base("scores").sql("SELECT DISTINCT model FROM scores"))
def e15_keys(spark, d):
    """Distinct keys of a column."""
    return RL.keys(V.scores(spark, d), "model")


# ---------------------------------------------------------------- F

@register("f1_avg_rank", lambda: base("scores").sql("""
SELECT event_id, model, rank() OVER (PARTITION BY model ORDER BY auc)
       + (count(*) OVER (PARTITION BY model, auc) - 1) / 2.0 AS rank FROM scores"""))
def f1_avg_rank(spark, d):
    """average rank with ties per model."""
    s = V.scores(spark, d).select("event_id", "model", "auc")
    return ST.avg_rank(s, ["model"], "auc", distributed=True).select("event_id", "model", "rank")


def _bin_curve_sql(kmax: int = 9) -> str:
    """DuckDB: within-bin sum of squares of x3 over k equal-width bins of x1."""
    return f"""
SELECT dataset, k, sum(ss) AS inertia FROM (
  SELECT dataset, k, b, var_pop(x3) * count(*) AS ss FROM (
    SELECT s.dataset, s.x3, k.k,
           least(CAST(floor(CASE WHEN mx > mn THEN (s.x1 - mn) / (mx - mn) ELSE 0.0 END * k.k) AS BIGINT), k.k - 1) AS b
    FROM samples s JOIN (SELECT dataset, min(x1) AS mn, max(x1) AS mx FROM samples GROUP BY dataset) r
      ON s.dataset = r.dataset, (SELECT unnest(range(1, {kmax + 1})) AS k) k) t
  GROUP BY dataset, k, b) u GROUP BY dataset, k"""


@register("f2_second_difference", lambda: base("samples").sql(f"""
SELECT dataset, k, {r6('lead(inertia, 2) OVER w - 2 * lead(inertia, 1) OVER w + inertia', 2)} AS d2
FROM ({_bin_curve_sql()}) c WINDOW w AS (PARTITION BY dataset ORDER BY k)"""))
def f2_second_difference(spark, d):
    """second difference of a per-dataset curve (inertia of k equal-width bins)."""
    from vantage.operators.cluster import bin_inertia_curve
    curve = bin_inertia_curve(V.samples(spark, d), ["dataset"], "x1", "x3", 9)
    out = RL.second_difference(curve, ["dataset"], "k", "inertia")
    return out.select("dataset", "k", F.round("d2", 2).alias("d2"))


@register("f3_top_rows", lambda: base("samples").sql(f"""
SELECT dataset, rank, {r6('x3')} AS x3 FROM (
  SELECT dataset, x3, row_number() OVER (PARTITION BY dataset ORDER BY x3 DESC, ok, ln, pk) AS rank FROM samples) t
WHERE rank <= 5"""))
def f3_top_rows(spark, d):
    """row number for top-k per group (WindowGroupLimit)."""
    s = V.samples(spark, d).select("dataset", "x3", "ok", "ln", "pk")
    return RL.top_k(s, "x3", 5, ["dataset"], ["ok", "ln", "pk"]).select("dataset", "rank", "x3")


@register("f4_leaderboard", lambda: base("scores").sql(f"""
SELECT model, {r6('m')} AS distance_correlation_mean, rank() OVER (ORDER BY m DESC) AS position FROM (
  SELECT model, avg(distance_correlation) AS m FROM scores GROUP BY model) g"""))
def f4_leaderboard(spark, d):
    """leaderboard position by mean score (on aggregated rows)."""
    g = ST.summarize(V.scores(spark, d), ["model"], ["distance_correlation"], ["mean"])
    return RL.leaderboard(g, "distance_correlation_mean")


# ---------------------------------------------------------------- G

@register("g1_sorted_summary", lambda: base("scores").sql(f"""
SELECT function_type, model, {r6('m')} AS mean,
       row_number() OVER (PARTITION BY function_type ORDER BY m DESC, model) AS position FROM (
  SELECT {FT_SQL} AS function_type, model, avg(distance_correlation) AS m FROM scores
  WHERE {FT_SQL} IS NOT NULL GROUP BY 1, 2) g"""))
def g1_sorted_summary(spark, d):
    """G1: summary sorted by mean descending within function type (order as a column)."""
    g = ST.summarize(scored(spark, d), ["function_type", "model"], ["distance_correlation"], ["mean"])
    g = g.withColumnRenamed("distance_correlation_mean", "mean")
    w = Window.partitionBy("function_type").orderBy(F.col("mean").desc(), "model")
    return g.withColumn("position", F.row_number().over(w).cast("bigint")).orderBy("function_type", "position")


@register("g2_top3", lambda: base("scores").sql(f"""
SELECT dataset, {r6('m')} AS cosine_similarity FROM (
  SELECT dataset, avg(cosine_similarity) AS m FROM scores GROUP BY dataset) g ORDER BY m DESC, dataset LIMIT 3"""))
def g2_top3(spark, d):
    """The three datasets with the highest mean cosine similarity."""
    g = V.scores(spark, d).groupBy("dataset").agg(F.avg("cosine_similarity").alias("cosine_similarity"))
    return RL.top_k(g, "cosine_similarity", 3, tiebreak=["dataset"])


@register("g4_first_n", lambda: base("samples").sql(
    "SELECT DISTINCT dataset FROM samples ORDER BY dataset LIMIT 5"))
def g4_first_n(spark, d):
    """The first N datasets in sorted order."""
    return V.samples(spark, d).select("dataset").distinct().orderBy("dataset").limit(5)


# ---------------------------------------------------------------- H

@register("h1_union", lambda: base("pairs").sql(f"""
SELECT model, count(*) AS n, count(note) AS n_note, {r6('avg(r2)')} AS r2_mean FROM (
  SELECT dataset, model, r2, NULL AS note FROM pairs WHERE model = 'unassisted'
  UNION ALL SELECT dataset, model, r2, 'assisted run' AS note FROM pairs WHERE model = 'assisted') t GROUP BY model"""))
def h1_union(spark, d):
    """H1: union by name of per-set results (missing columns as NULL)."""
    p = R.regression_pairs(spark, d)
    un = p.where(F.col("model") == "unassisted").select("dataset", "model", "r2")
    asd = p.where(F.col("model") == "assisted").select("dataset", "model", "r2", F.lit("assisted run").alias("note"))
    u = RL.union_results(un, asd)
    return u.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("n_note"),
                                  F.avg("r2").alias("r2_mean"))


@register("h2_append_dedupe", lambda: base("scores").sql("""
SELECT model, count(*) AS n FROM (
  SELECT DISTINCT * FROM (SELECT * FROM scores WHERE model <> 'click' UNION ALL
                          SELECT * FROM scores WHERE model <> 'view') t) u GROUP BY model"""))
def h2_append_dedupe(spark, d):
    """H2: append new results to old ones and drop exact duplicates."""
    s = V.scores(spark, d)
    return RL.append_dedupe(s.where(F.col("model") != "click"), s.where(F.col("model") != "view")).groupBy(
        "model").agg(F.count(F.lit(1)).alias("n"))
