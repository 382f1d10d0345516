"""Registered queries for L (statistics) and M (reports), with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.functions import dist
from vantage.functions import expr as B
from vantage.operators import models as K
from vantage.operators import relational as RL
from vantage.operators import stats as ST
from vantage.plans import duck as D
from vantage.plans import reports as R
from vantage.plans.catalog import register
from vantage.plans.queries_agg import FT_SQL, _box_sql, ci_sql_cols, scored
from vantage.plans.queries_base import WIDE_PAIRS_SQL, base, wide_pairs
from vantage.sources import testdata as V

r6 = D.r6


def _r4(c: str):
    return F.round(F.col(c), 4).alias(c)


# ---------------------------------------------------------------- shared SQL pieces

def classification_sql() -> str:
    return """
SELECT dataset, 'cluster_' || model AS cluster,
       CASE WHEN dc < 0.2 THEN 'LogisticReg' WHEN dc < 0.5 THEN 'RandomForest' ELSE 'GradientBoost' END AS best_model,
       auc FROM (SELECT dataset, model, avg(auc) AS auc, avg(distance_correlation) AS dc FROM scores GROUP BY 1, 2) g"""


AUC_SQL = """SELECT dataset, model, avg(auc) AS a, avg(0.5 + distance_correlation / 2.0) AS u FROM scores GROUP BY 1, 2"""


def paired_sql(src: str, by: str, a: str, b: str, na: str, nb: str, q: D.CTE, tag: str) -> str:
    """DuckDB twin of ``reports.paired_summary`` grouped by ``by`` (may be '')."""
    grp = f"GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    q.add(f"{tag}_g", f"""SELECT {sel}count({a} - {b}) AS n, avg({a}) AS ma, stddev_samp({a}) AS sa,
       avg({b}) AS mb, stddev_samp({b}) AS sb, avg({a} - {b}) AS md, stddev_samp({a} - {b}) AS sd FROM {src} {grp}""")
    q.add(f"{tag}_q", f"SELECT *, CASE WHEN n > 1 THEN {D.t_ppf(0.975, 'n - 1')} END AS q FROM {tag}_g")
    t, _ = D.paired_ttest_cols("n", "md", "sd")
    q.add(f"{tag}_t", f"SELECT *, {t} AS t_stat FROM {tag}_q")
    p = f"(CASE WHEN t_stat IS NOT NULL THEN {D.t_sf2('t_stat', 'n - 1')} END)"
    return f"""SELECT {sel}n, {r6('ma')} AS mean_{na}, {r6('(CASE WHEN n > 1 THEN sa END) / sqrt(n) * q')} AS ci_{na},
       {r6('mb')} AS mean_{nb}, {r6('(CASE WHEN n > 1 THEN sb END) / sqrt(n) * q')} AS ci_{nb},
       {r6('t_stat')} AS t_stat, {r6(p)} AS p_value FROM {tag}_t"""


def wilcoxon_sql(src: str, by: str, a: str, b: str, q: D.CTE, tag: str) -> str:
    """DuckDB twin of ``stats.wilcoxon``; ``by`` is one column."""
    q.add(f"{tag}_d", f"SELECT {by}, {a} - {b} AS d, abs({a} - {b}) AS ad FROM {src} WHERE {a} - {b} <> 0")
    q.add(f"{tag}_r", f"""SELECT {by}, d, {D.avg_rank_sql(by, 'ad')} AS r,
       count(*) OVER (PARTITION BY {by}, ad) AS t FROM {tag}_d""")
    q.add(f"{tag}_s", f"""SELECT {by}, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0.0 END) AS wp,
       sum(CASE WHEN d < 0 THEN r ELSE 0.0 END) AS wm, sum((t * t * t - t) / t) AS tie, max(t) AS maxt
       FROM {tag}_r GROUP BY {by}""")
    q.add(f"{tag}_z", f"""SELECT *, least(wp, wm) AS stat,
       n * (n + 1) * (2 * n + 1) / 24.0 - tie / 48.0 AS var FROM {tag}_s""")
    exact = f"least(1.0, 2.0 * {D.exact_signed_rank_cdf('n', 'stat')})"
    z = D.div("stat - n * (n + 1) / 4.0", "sqrt(var)")
    p = f"CASE WHEN n <= 50 AND maxt = 1 THEN {exact} WHEN var > 0 THEN {D.norm_sf2(z)} END"
    return f"SELECT {by}, n, {r6('stat')} AS w_stat, {r6(p)} AS w_p FROM {tag}_z"


# ---------------------------------------------------------------- L

@register("l2_pearson", lambda: base("samples").sql(f"""
SELECT dataset, n, {r6('r')} AS r, {r6(f"CASE WHEN r IS NULL OR n < 3 THEN NULL WHEN abs(r) >= 1 THEN 0.0 ELSE {D.t_sf2('r * sqrt((n - 2) / (1.0 - r * r))', 'n - 2')} END")} AS p_value FROM (
  SELECT dataset, count(*) AS n, CASE WHEN stddev_pop(x1) > 0 AND stddev_pop(x3) > 0 THEN
         greatest(least(covar_pop(x1, x3) / (stddev_pop(x1) * stddev_pop(x3)), 1.0), -1.0) END AS r
  FROM samples GROUP BY dataset) g"""))
def l2_pearson(spark, d):
    """L2: Pearson r and two-sided p of x1 and x3 per dataset."""
    return ST.pearson(V.samples(spark, d), ["dataset"], "x1", "x3")


@register("l3_spearman", lambda: base("raw").sql(f"""
SELECT dataset, n, {r6('r')} AS rho, {r6(f"CASE WHEN r IS NULL OR n < 3 THEN NULL WHEN abs(r) >= 1 THEN 0.0 ELSE {D.t_sf2('r * sqrt((n - 2) / (1.0 - r * r))', 'n - 2')} END")} AS p_value FROM (
  SELECT dataset, count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN
         greatest(least(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 1.0), -1.0) END AS r FROM (
    SELECT dataset, {D.avg_rank_sql('dataset', 'x1')} AS rx, {D.avg_rank_sql('dataset', 'x2')} AS ry FROM raw) t
  GROUP BY dataset) g"""))
def l3_spearman(spark, d):
    """L3: Spearman rho (Pearson on average ranks) of two coordinates per dataset."""
    return ST.spearman(V.emb_raw(spark, d), ["dataset"], "x1", "x2")


def _pairs_eq_sql(q: D.CTE) -> str:
    return q.add("weq", f"""SELECT w.*, regexp_extract(w.dataset, '_([a-z]+)$', 1) AS equation FROM ({WIDE_PAIRS_SQL}) w""")


def _wide_eq(spark, d):
    return wide_pairs(spark, d).withColumn("equation", F.regexp_extract("dataset", r"_([a-z]+)$", 1))


def _l4_sql():
    q = base("pairs")
    _pairs_eq_sql(q)
    return q.sql(paired_sql("weq", "equation", "mae_unassisted", "mae_assisted", "unassisted", "assisted", q, "p"))


@register("l4_ttest_paired", _l4_sql)
def l4_ttest_paired(spark, d):
    """L4: paired t-test of unassisted vs assisted MAE per equation family."""
    return R.paired_summary(_wide_eq(spark, d), ["equation"], "mae_unassisted", "mae_assisted",
                            names=("unassisted", "assisted"))


@register("l5_ttest_welch", lambda: base("samples").sql(f"""
SELECT dataset, n_true, {r6('m1')} AS mean_true, n_false, {r6('m2')} AS mean_false, {r6('t')} AS t_stat,
       {r6('dof')} AS dof, {r6(f"CASE WHEN t IS NOT NULL AND dof >= 1 THEN {D.t_sf2('t', 'dof')} END")} AS p_value FROM (
  SELECT *, {', '.join(f'{e} AS {n}' for e, n in zip(D.welch_cols('n_true', 'm1', 'v1', 'n_false', 'm2', 'v2'), ['t', 'dof']))} FROM (
    SELECT dataset, count(CASE WHEN cat1 = 'B' THEN x3 END) AS n_true, avg(CASE WHEN cat1 = 'B' THEN x3 END) AS m1,
           var_samp(CASE WHEN cat1 = 'B' THEN x3 END) AS v1, count(CASE WHEN cat1 <> 'B' THEN x3 END) AS n_false,
           avg(CASE WHEN cat1 <> 'B' THEN x3 END) AS m2, var_samp(CASE WHEN cat1 <> 'B' THEN x3 END) AS v2
    FROM samples GROUP BY dataset) g) h"""))
def l5_ttest_welch(spark, d):
    """Welch t-test of x3 between the two cat1 levels per dataset."""
    s = V.samples(spark, d).withColumn("is_b", F.col("cat1") == "B")
    return ST.ttest_welch(s, ["dataset"], "x3", "is_b")


def _l6_sql():
    q = base("scores")
    q.add("g", f"""SELECT {FT_SQL} AS function_type, model, count(auc) AS n, sum(auc) AS s, sum(auc * auc) AS ss,
       avg(auc) AS m, var_samp(auc) AS v FROM scores GROUP BY 1, 2""")
    q.add("h", """SELECT *, sum(n) OVER (PARTITION BY function_type) - n AS rn,
       sum(s) OVER (PARTITION BY function_type) - s AS rs, sum(ss) OVER (PARTITION BY function_type) - ss AS rss FROM g""")
    q.add("h2", f"SELECT *, {D.div('rs', 'rn')} AS rm FROM h")
    q.add("h3", f"SELECT *, greatest({D.div('rss - rn * rm * rm', 'rn - 1')}, 0.0) AS rv FROM h2")
    t, dof = D.welch_cols("n", "m", "v", "rn", "rm", "rv")
    q.add("h4", f"SELECT *, {t} AS t_stat, {dof} AS dof FROM h3")
    p = f"CASE WHEN t_stat IS NOT NULL AND dof >= 1 THEN {D.t_sf2('t_stat', 'dof')} END"
    q.add("h5", f"SELECT *, {p} AS p_value FROM h4")
    return q.sql(f"""SELECT function_type, model, n, {r6('m')} AS mean, CAST(rn AS BIGINT) AS n_rest, {r6('rm')} AS mean_rest,
       {r6('t_stat')} AS t_stat, {r6('dof')} AS dof, {r6('p_value')} AS p_value,
       coalesce(p_value < 0.05, false) AS significant FROM h5""")


@register("l6_one_vs_rest", _l6_sql)
def l6_one_vs_rest(spark, d):
    """Welch test of each model's AUC against all other models, per function type."""
    return ST.one_vs_rest_ttest(scored(spark, d), ["function_type"], "model", "auc")


def _l7_sql():
    q = base("pairs")
    _pairs_eq_sql(q)
    return q.sql(wilcoxon_sql("weq", "equation", "mae_unassisted", "mae_assisted", q, "w"))


@register("l7_wilcoxon", _l7_sql)
def l7_wilcoxon(spark, d):
    """Wilcoxon signed-rank of unassisted vs assisted MAE per equation family."""
    w = ST.wilcoxon(_wide_eq(spark, d), ["equation"], "mae_unassisted", "mae_assisted")
    return w.select("equation", "n", F.col("statistic").alias("w_stat"), F.col("p_value").alias("w_p"))


@register("l8_mannwhitney", lambda: base("samples").sql(f"""
SELECT dataset, n_true, n_false, {r6('u1')} AS u_stat,
       {r6(f"CASE WHEN n_true > 0 AND n_false > 0 AND sigma > 0 THEN least(1.0, {D.norm_sf2('z')}) END")} AS p_value FROM (
  SELECT *, {D.div('greatest(u1, n_true * n_false - u1) - n_true * n_false / 2.0 - 0.5', 'sigma')} AS z FROM (
    SELECT *, rx - n_true * (n_true + 1) / 2.0 AS u1,
           sqrt(n_true * n_false / 12.0 * ((n_true + n_false + 1) - {D.div('tie', '(n_true + n_false) * (n_true + n_false - 1)')})) AS sigma
    FROM (
      SELECT dataset, count(CASE WHEN f THEN 1 END) AS n_true, count(CASE WHEN NOT f THEN 1 END) AS n_false,
             sum(CASE WHEN f THEN r ELSE 0.0 END) AS rx, sum((t * t * t - t) / t) AS tie FROM (
        SELECT dataset, cat2 = 'Y' AS f, {D.avg_rank_sql('dataset', 'x3')} AS r,
               count(*) OVER (PARTITION BY dataset, x3) AS t FROM samples) a GROUP BY dataset) b) c) e"""))
def l8_mannwhitney(spark, d):
    """Mann-Whitney U of x3 between the two cat2 levels per dataset."""
    s = V.samples(spark, d).withColumn("is_y", F.col("cat2") == "Y")
    return ST.mannwhitney(s, ["dataset"], "x3", "is_y")


def _bp_sql():
    q = base("samples")
    q.add("mom", D.moments_sql("samples", ["dataset"], "x3", ["x1", "x2"]))
    c = D.solve_sql(q, "mom", ["dataset"], [0, 1, 2], ["x1", "x2"], "b_", tag="g")
    q.add("res", f"""SELECT s.dataset, s.x1, s.x2, pow(s.x3 - (c.b_intercept + c.b_x1 * s.x1 + c.b_x2 * s.x2), 2) AS u
       FROM samples s JOIN {c} c ON s.dataset = c.dataset""")
    q.add("mom2", D.moments_sql("res", ["dataset"], "u", ["x1", "x2"]))
    c2 = D.solve_sql(q, "mom2", ["dataset"], [0, 1, 2], ["x1", "x2"], "a_", tag="h")
    q.add("fit", f"""SELECT r.dataset, count(*) AS n, sum(pow(r.u - (c.a_intercept + c.a_x1 * r.x1 + c.a_x2 * r.x2), 2)) AS sse,
       var_pop(r.u) * count(*) AS sst FROM res r JOIN {c2} c ON r.dataset = c.dataset GROUP BY r.dataset""")
    lm = f"n * (1.0 - {D.div('sse', 'sst')})"
    return q.sql(f"""SELECT dataset, n, {r6(lm)} AS lm_stat, {r6(D.chi2_sf(lm, 2))} AS p_value FROM fit""")


@register("l9_breusch_pagan", _bp_sql)
def l9_breusch_pagan(spark, d):
    """Breusch-Pagan LM = n R^2 of squared residuals on the regressors (x3 ~ x1 + x2)."""
    return ST.breusch_pagan(V.samples(spark, d), ["dataset"], "x3", ["x1", "x2"])


@register("l10_regression_line", lambda: base("pairs", "meta").sql(f"""
SELECT count(*) AS n, {r6('regr_slope(p.r2, m.subject_variable_ratio)')} AS slope,
       {r6('regr_intercept(p.r2, m.subject_variable_ratio)')} AS intercept
FROM pairs p JOIN meta m ON p.dataset = m.dataset WHERE p.model = 'unassisted' AND p.r2 > 0.2"""))
def l10_regression_line(spark, d):
    """L10 (line): least-squares line of R2 on SVR."""
    j = R.regression_pairs(spark, d).where((F.col("model") == "unassisted") & (F.col("r2") > 0.2))
    j = j.join(V.dataset_meta(spark, d), "dataset")
    return ST.regression_line(j, [], "subject_variable_ratio", "r2")


@register("l10_regression_band")
def l10_regression_band(spark, d):
    """L10 (band): 95% bootstrap band of the line of R2 on SVR, 200 replicates on a grid of 100 points."""
    j = R.regression_pairs(spark, d).where((F.col("model") == "unassisted") & (F.col("r2") > 0.2))
    j = R.materialize(j.join(V.dataset_meta(spark, d), "dataset"))
    return ST.regression_band(j, [], "subject_variable_ratio", "r2", "dataset")


# ---------------------------------------------------------------- M

@register("m1_similarity_report", lambda: base("scores").sql(f"""
SELECT function_type, model, {r6('m')} AS mean, {r6('sem')} AS sem,
       printf('%.3f ± %.3f', m, sem) AS summary,
       row_number() OVER (PARTITION BY function_type ORDER BY m DESC, model) AS position FROM (
  SELECT {FT_SQL} AS function_type, model, avg(distance_correlation) AS m,
         stddev_samp(distance_correlation) / sqrt(count(distance_correlation)) AS sem
  FROM scores WHERE {FT_SQL} IS NOT NULL GROUP BY 1, 2) g"""))
def m1_similarity_report(spark, d):
    """M1: mean +- SEM of the distance correlation per function type and model, sorted."""
    g = ST.summarize(scored(spark, d), ["function_type", "model"], ["distance_correlation"], ["mean", "sem"])
    g = g.select("function_type", "model", F.col("distance_correlation_mean").alias("mean"),
                 F.col("distance_correlation_sem").alias("sem"))
    w = Window.partitionBy("function_type").orderBy(F.col("mean").desc(), "model")
    return g.select("*", B.mean_pm("mean", "sem").alias("summary"), F.row_number().over(w).cast("bigint").alias("position"))


@register("m2_similarity_ci", lambda: base("scores").sql(f"""
SELECT model, function_type, {ci_sql_cols('n', 'm', 's')} FROM (
  SELECT model, {FT_SQL} AS function_type, count(distance_correlation) AS n, avg(distance_correlation) AS m,
         stddev_samp(distance_correlation) AS s FROM scores WHERE {FT_SQL} IS NOT NULL GROUP BY 1, 2) g"""))
def m2_similarity_ci(spark, d):
    """M2: 95% CI of the distance correlation per model and function type."""
    return ST.summarize_ci(scored(spark, d), ["model", "function_type"], "distance_correlation")


@register("m3_score_distributions", lambda: base("scores").sql(_box_sql(
    f"(SELECT {FT_SQL} || '|' || model AS cell, distance_correlation FROM scores WHERE {FT_SQL} IS NOT NULL)",
    "cell", "distance_correlation")))
def m3_score_distributions(spark, d):
    """M3: box statistics of the distance correlation by function type x model."""
    s = scored(spark, d).where(F.col("function_type").isNotNull())
    s = s.select(F.concat_ws("|", "function_type", "model").alias("cell"), "distance_correlation")
    return RL.box_stats(s, ["cell"], "distance_correlation", outliers=True)


@register("m4_leaderboard", lambda: base("scores").sql(f"""
SELECT model, {r6('dm')} AS distance_mean, {r6('ds')} AS distance_std, {r6('cm')} AS cosine_mean,
       {r6('cs')} AS cosine_std, rank() OVER (ORDER BY dm DESC) AS distance_position,
       rank() OVER (ORDER BY cm DESC) AS cosine_position FROM (
  SELECT model, avg(distance_correlation) AS dm, stddev_samp(distance_correlation) AS ds,
         avg(TRY_CAST(CAST(cosine_similarity AS VARCHAR) AS DOUBLE)) AS cm, stddev_samp(cosine_similarity) AS cs
  FROM scores GROUP BY model) g"""))
def m4_leaderboard(spark, d):
    """M4: model leaderboards by mean distance correlation and mean cosine."""
    s = V.scores(spark, d).withColumn("cosine_similarity", B.to_numeric(F.col("cosine_similarity")))
    g = ST.summarize(s, ["model"], ["distance_correlation", "cosine_similarity"])
    g = B.standardize_summary(g, {"distance_correlation_mean": "distance_mean", "distance_correlation_std": "distance_std",
                                  "cosine_similarity_mean": "cosine_mean", "cosine_similarity_std": "cosine_std"})
    g = RL.leaderboard(g, "distance_mean", out="distance_position")
    return RL.leaderboard(g, "cosine_mean", out="cosine_position")


def _m5_sql():
    q = base("pairs", "meta")
    q.add("f", """SELECT p.dataset, p.r2, m.subject_variable_ratio AS svr, CAST(m.num_categorical_vars AS DOUBLE) AS ncat
       FROM pairs p JOIN meta m ON p.dataset = m.dataset WHERE p.model = 'unassisted' AND p.r2 > 0.2""")
    def pr(x):
        r = f"CASE WHEN stddev_pop({x}) > 0 AND stddev_pop(r2) > 0 THEN greatest(least(covar_pop({x}, r2) / (stddev_pop({x}) * stddev_pop(r2)), 1.0), -1.0) END"
        return r
    q.add("g", f"""SELECT count(*) AS n, {pr('svr')} AS r_svr, {pr('ncat')} AS r_ncat,
       regr_slope(r2, svr) AS slope, regr_intercept(r2, svr) AS intercept,
       count(CASE WHEN svr < 20 THEN 1 END) AS n_low_density FROM f""")
    def pv(r):
        return (f"CASE WHEN {r} IS NULL OR n < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0.0 ELSE "
                f"{D.t_sf2(f'{r} * sqrt((n - 2) / (1.0 - {r} * {r}))', 'n - 2')} END")
    return q.sql(f"""SELECT n, {r6('r_svr')} AS r_svr, {r6(pv('r_svr'))} AS p_svr, {r6('r_ncat')} AS r_ncat,
       {r6(pv('r_ncat'))} AS p_ncat, {r6('slope')} AS slope, {r6('intercept')} AS intercept, n_low_density FROM g""")


@register("m5_structural_sensitivity", _m5_sql)
def m5_structural_sensitivity(spark, d):
    """M5: r, p and N of R2 against SVR and category count (R2 > 0.2), the
    fitted line and the low-density count (SVR < 20)."""
    j = R.regression_pairs(spark, d).where(F.col("model") == "unassisted")
    j = RL.quality_filter(j.join(V.dataset_meta(spark, d), "dataset"), "r2", 0.2)
    j = j.withColumn("ncat", F.col("num_categorical_vars").cast("double"))
    # one aggregate: both correlations, the line and the low-density count
    r = ST.pearson_many(j, [], [("subject_variable_ratio", "r2", "svr"), ("ncat", "r2", "ncat")])
    c = j.agg(F.regr_slope("r2", "subject_variable_ratio").alias("slope"),
              F.regr_intercept("r2", "subject_variable_ratio").alias("intercept"),
              F.count(F.when(F.col("subject_variable_ratio") < 20, 1)).alias("n_low_density"))
    return RL.attach(r, c)


def _m7_sql():
    q = base("pairs", "meta")
    q.add("f", """SELECT p.dataset, p.r2, m.subject_variable_ratio AS svr, CAST(m.num_categorical_vars AS DOUBLE) AS ncat,
       1 AS one FROM pairs p JOIN meta m ON p.dataset = m.dataset WHERE p.model = 'unassisted' AND p.r2 > 0.2""")
    q.add("bpm", D.moments_sql("f", ["one"], "r2", ["svr", "ncat"]))
    c = D.solve_sql(q, "bpm", ["one"], [0, 1, 2], ["svr", "ncat"], "b_", tag="bg")
    q.add("res", f"""SELECT f.one, f.svr, f.ncat, pow(f.r2 - (c.b_intercept + c.b_svr * f.svr + c.b_ncat * f.ncat), 2) AS u
       FROM f JOIN {c} c ON f.one = c.one""")
    q.add("bpm2", D.moments_sql("res", ["one"], "u", ["svr", "ncat"]))
    c2 = D.solve_sql(q, "bpm2", ["one"], [0, 1, 2], ["svr", "ncat"], "a_", tag="bh")
    q.add("fit", f"""SELECT count(*) AS n, sum(pow(r.u - (c.a_intercept + c.a_svr * r.svr + c.a_ncat * r.ncat), 2)) AS sse,
       var_pop(r.u) * count(*) AS sst FROM res r JOIN {c2} c ON r.one = c.one""")
    q.add("bp", f"SELECT n, n * (1.0 - {D.div('sse', 'sst')}) AS lm FROM fit")
    p = D.chi2_sf("lm", 2)
    return q.sql(f"""SELECT n, {r6('lm')} AS lm_stat, {r6(p)} AS p_value,
       CASE WHEN {p} < 0.05 THEN 'heteroscedastic: cut-offs justified' ELSE 'homoscedastic: cut-offs exploratory' END
       AS verdict FROM bp""")


@register("m7_residual_diagnostics", _m7_sql)
def m7_residual_diagnostics(spark, d):
    """M7: OLS of R2 on SVR and category count (R2 > 0.2), Breusch-Pagan and the verdict."""
    j = R.regression_pairs(spark, d).where(F.col("model") == "unassisted")
    j = RL.quality_filter(j.join(V.dataset_meta(spark, d), "dataset"), "r2", 0.2)
    j = j.select("r2", F.col("subject_variable_ratio").alias("svr"),
                 F.col("num_categorical_vars").cast("double").alias("ncat"))
    bp = ST.breusch_pagan(j, [], "r2", ["svr", "ncat"])
    verdict = F.when(F.col("p_value") < 0.05, F.lit("heteroscedastic: cut-offs justified")).otherwise(
        F.lit("homoscedastic: cut-offs exploratory"))
    return bp.select("n", "lm_stat", "p_value", verdict.alias("verdict"))


def _m8_sql():
    q = base("scores")
    q.add("cls", classification_sql())
    q.add("best", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY auc DESC NULLS LAST,
       cluster) AS rn FROM cls WHERE TRY_CAST(auc AS DOUBLE) IS NOT NULL) t WHERE rn = 1""")
    lab = "CASE cluster " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.CLUSTER_LABELS.items()) + " END"
    return q.sql(f"""SELECT label, {ci_sql_cols('n', 'm', 's')} FROM (
  SELECT {lab} AS label, count(auc) AS n, avg(auc) AS m, stddev_samp(auc) AS s FROM best GROUP BY 1) g""")


@register("m8_best_cluster", _m8_sql)
def m8_best_cluster(spark, d):
    """M8: best cluster column per dataset, then AUC mean / 95% CI per label."""
    return R.best_cluster(R.classification_results(spark, d), R.CLUSTER_LABELS)


def _m9_sql():
    q = base("scores")
    q.add("cls", classification_sql())
    lab = "CASE cluster " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.CLUSTER_LABELS.items()) + " END"
    q.add("lab", f"SELECT *, {lab} AS label FROM cls")
    q.add("g", "SELECT label, count(auc) AS n, sum(auc) AS s, sum(auc * auc) AS ss, avg(auc) AS m, var_samp(auc) AS v FROM lab GROUP BY label")
    q.add("h", """SELECT *, sum(n) OVER () - n AS rn, sum(s) OVER () - s AS rs, sum(ss) OVER () - ss AS rss FROM g""")
    q.add("h2", f"SELECT *, {D.div('rs', 'rn')} AS rm FROM h")
    q.add("h3", f"SELECT *, greatest({D.div('rss - rn * rm * rm', 'rn - 1')}, 0.0) AS rv FROM h2")
    t, dof = D.welch_cols("n", "m", "v", "rn", "rm", "rv")
    q.add("h4", f"SELECT label, {t} AS t_stat, {dof} AS dof FROM h3")
    q.add("h5", f"SELECT label, CASE WHEN t_stat IS NOT NULL AND dof >= 1 THEN {D.t_sf2('t_stat', 'dof')} END AS p_value FROM h4")
    return q.sql(f"""SELECT a.label, a.best_model, count(a.auc) AS n, {r6('avg(a.auc)')} AS mean,
       {r6('stddev_samp(a.auc) / sqrt(count(a.auc))')} AS sem, {r6('max(h5.p_value)')} AS p_value,
       coalesce(max(h5.p_value) < 0.05, false) AS significant
       FROM lab a JOIN h5 ON a.label = h5.label GROUP BY a.label, a.best_model""")


@register("m9_auc_significance", _m9_sql)
def m9_auc_significance(spark, d):
    """M9: AUC mean / SEM by (label, best model) with a label-vs-rest Welch flag."""
    return R.auc_significance(R.classification_results(spark, d), R.CLUSTER_LABELS)


@register("m10_assisted_auc", lambda: base("scores").sql(f"""
SELECT a.model, count(*) AS n, {r6('avg(a.a)')} AS mean_assisted, {r6('avg(a.a - a.u)')} AS mean_delta,
       {r6('quantile_cont(a.a, 0.25)')} AS q1, {r6('quantile_cont(a.a, 0.5)')} AS median,
       {r6('quantile_cont(a.a, 0.75)')} AS q3 FROM ({AUC_SQL}) a GROUP BY a.model"""))
def m10_assisted_auc(spark, d):
    """Assisted AUC by algorithm: mean, mean gain over unassisted, quartiles."""
    return R.assisted_auc(*R.auc_results(spark, d))


def _m11_sql():
    q = base("scores")
    q.add("auc", AUC_SQL)
    q.add("j", """SELECT dataset, max(u) AS auc_unassisted, max(a) AS auc_assisted FROM auc GROUP BY dataset""")
    q.add("c", "SELECT *, auc_assisted > auc_unassisted AS llm_better FROM j WHERE auc_assisted >= 0.6 AND auc_unassisted >= 0.6")
    q.add("sub", "SELECT 'all' AS subset, * FROM c UNION ALL SELECT 'better_only', * FROM c WHERE llm_better")
    return q.sql(paired_sql("sub", "subset", "auc_unassisted", "auc_assisted", "unassisted", "assisted", q, "p"))


@register("m11_paired_auc", _m11_sql)
def m11_paired_auc(spark, d):
    """Best AUC per dataset for both methods, AUC >= 0.6 on both, paired
    comparison for all datasets and for those where assisted is better."""
    return R.paired_auc(*R.auc_results(spark, d))


def _m12_sql():
    q = base("pairs", "meta")
    q.add("w", f"SELECT * FROM ({WIDE_PAIRS_SQL}) x WHERE r2_unassisted IS NOT NULL AND r2_assisted IS NOT NULL")
    q.add("sub", """SELECT 'all' AS subset, dataset, r2_unassisted, r2_assisted FROM w UNION ALL
       SELECT 'refined', w.dataset, r2_unassisted, r2_assisted FROM w JOIN meta m ON w.dataset = m.dataset
       WHERE m.subject_variable_ratio >= 20 AND m.num_categorical_vars <= 25""")
    ps = paired_sql("sub", "subset", "r2_unassisted", "r2_assisted", "unassisted", "assisted", q, "p")
    q.add("ps", ps)
    ws = wilcoxon_sql("sub", "subset", "r2_unassisted", "r2_assisted", q, "w")
    q.add("ws", ws)
    return q.sql("SELECT ps.*, ws.w_stat, ws.w_p FROM ps JOIN ws ON ps.subset = ws.subset")


@register("m12_paired_r2", _m12_sql)
def m12_paired_r2(spark, d):
    """Paired R2 (CI, t-test, Wilcoxon) for all datasets and after the
    metadata cut-offs (SVR >= 20, categories <= 25)."""
    w = RL.drop_missing(wide_pairs(spark, d), ["r2_unassisted", "r2_assisted"])
    meta = V.dataset_meta(spark, d)
    refined = RL.cutoff_filter(w.join(meta, "dataset")).select(*w.columns)
    sub = w.withColumn("subset", F.lit("all")).unionByName(refined.withColumn("subset", F.lit("refined")))
    ps = R.paired_summary(sub, ["subset"], "r2_unassisted", "r2_assisted", names=("unassisted", "assisted"))
    ws = ST.wilcoxon(sub, ["subset"], "r2_unassisted", "r2_assisted").select(
        "subset", F.col("statistic").alias("w_stat"), F.col("p_value").alias("w_p"))
    return ps.join(ws, "subset")


def _m13_sql():
    q = base("pairs")
    q.add("w", f"SELECT t.thr, x.* FROM ({WIDE_PAIRS_SQL}) x, (SELECT unnest([0.2::DOUBLE, 0.6::DOUBLE]) AS thr) t "
               "WHERE x.r2_unassisted > t.thr AND x.r2_assisted > t.thr")
    return q.sql(paired_sql("w", "thr", "mae_unassisted", "mae_assisted", "unassisted", "assisted", q, "p"))


@register("m13_paired_mae", _m13_sql)
def m13_paired_mae(spark, d):
    """Paired MAE at R2 > 0.2 and at R2 > 0.6 (threshold as a group key)."""
    w = wide_pairs(spark, d).withColumn("thr", F.explode(F.array(F.lit(0.2), F.lit(0.6))))
    w = w.where((F.col("r2_unassisted") > F.col("thr")) & (F.col("r2_assisted") > F.col("thr")))
    return R.paired_summary(w, ["thr"], "mae_unassisted", "mae_assisted", names=("unassisted", "assisted"))


def _m15_sql():
    q = base("pairs")
    q.add("w", f"SELECT 1 AS one, * FROM ({WIDE_PAIRS_SQL}) x WHERE r2_unassisted IS NOT NULL AND r2_assisted IS NOT NULL")
    q.add("ps", paired_sql("w", "one", "r2_unassisted", "r2_assisted", "unassisted", "assisted", q, "p"))
    q.add("wr", f"SELECT 1 AS one, avg(CAST(r2_assisted > r2_unassisted AS DOUBLE)) * 100.0 AS win_rate FROM w")
    return q.sql(f"""SELECT ps.n, ps.mean_unassisted, ps.ci_unassisted, ps.mean_assisted, ps.ci_assisted, ps.t_stat,
       ps.p_value, {r6('wr.win_rate')} AS win_rate,
       CASE WHEN ps.p_value < 0.05 THEN printf('Paired t-test: p = %.4f*', ps.p_value)
            ELSE printf('Paired t-test: p = %.4f (NS)', ps.p_value) END AS annotation
       FROM ps JOIN wr ON ps.one = wr.one""")


@register("m15_distribution_report", _m15_sql)
def m15_distribution_report(spark, d):
    """Win rate, mean +- CI of each side, paired t-test and its annotation."""
    w = RL.drop_missing(wide_pairs(spark, d), ["r2_unassisted", "r2_assisted"])
    ps = R.paired_summary(w, [], "r2_unassisted", "r2_assisted", names=("unassisted", "assisted"))
    wr = RL.win_rate(w.withColumn("_b", F.col("r2_assisted") > F.col("r2_unassisted")), "_b", []).drop("n")
    out = RL.attach(ps, wr)
    ann = F.when(F.col("p_value") < 0.05, F.format_string("Paired t-test: p = %.4f*", F.col("p_value"))).otherwise(
        F.format_string("Paired t-test: p = %.4f (NS)", F.col("p_value")))
    return out.withColumn("annotation", ann)


def _m16_sql():
    q = base("pairs", "meta")
    q.add("w", f"""SELECT x.dataset, x.r2_unassisted, x.r2_assisted, x.r2_assisted > x.r2_unassisted AS llm_better,
       m.subject_variable_ratio, CAST(m.num_categorical_vars AS DOUBLE) AS num_categorical_vars
       FROM ({WIDE_PAIRS_SQL}) x JOIN (SELECT meta.*, unnest(['cluster_m0', 'cluster_m1']) AS cluster FROM meta) m
       ON x.dataset = m.dataset WHERE x.r2_unassisted >= 0.2 AND x.r2_assisted >= 0.2""")
    q.add("l", """SELECT dataset, llm_better, 'subject_variable_ratio' AS feature, subject_variable_ratio AS value FROM w
       UNION ALL SELECT dataset, llm_better, 'num_categorical_vars', num_categorical_vars FROM w""")
    q.add("g", """SELECT feature, count(CASE WHEN llm_better THEN value END) AS nb, avg(CASE WHEN llm_better THEN value END) AS mb,
       stddev_samp(CASE WHEN llm_better THEN value END) AS sb, var_samp(CASE WHEN llm_better THEN value END) AS vb,
       count(CASE WHEN NOT llm_better THEN value END) AS nw, avg(CASE WHEN NOT llm_better THEN value END) AS mw,
       stddev_samp(CASE WHEN NOT llm_better THEN value END) AS sw, var_samp(CASE WHEN NOT llm_better THEN value END) AS vw
       FROM l GROUP BY feature""")
    t, dof = D.welch_cols("nb", "mb", "vb", "nw", "mw", "vw")
    q.add("g2", f"""SELECT *, {t} AS t_stat, {dof} AS dof,
       CASE WHEN nb > 1 THEN sb / sqrt(nb) * {D.t_ppf(0.975, 'nb - 1')} END AS hb,
       CASE WHEN nw > 1 THEN sw / sqrt(nw) * {D.t_ppf(0.975, 'nw - 1')} END AS hw FROM g""")
    q.add("u", f"""SELECT feature, count(CASE WHEN f THEN 1 END) AS n1, count(CASE WHEN NOT f THEN 1 END) AS n2,
       sum(CASE WHEN f THEN r ELSE 0.0 END) AS rx, sum((t * t * t - t) / t) AS tie FROM (
       SELECT feature, llm_better AS f, {D.avg_rank_sql('feature', 'value')} AS r,
              count(*) OVER (PARTITION BY feature, value) AS t FROM l) a GROUP BY feature""")
    q.add("u2", f"""SELECT *, rx - n1 * (n1 + 1) / 2.0 AS u1,
       sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - {D.div('tie', '(n1 + n2) * (n1 + n2 - 1)')})) AS sigma FROM u""")
    q.add("u3", f"""SELECT feature, CASE WHEN n1 > 0 AND n2 > 0 AND sigma > 0 THEN
       least(1.0, {D.norm_sf2(D.div('greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5', 'sigma'))}) END AS u_p FROM u2""")
    p = f"CASE WHEN t_stat IS NOT NULL AND dof >= 1 THEN {D.t_sf2('t_stat', 'dof')} END"
    return q.sql(f"""SELECT g2.feature, {r6('mb', 4)} AS mean_better, {r6('mb - hb', 4)} AS ci_low_b, {r6('mb + hb', 4)} AS ci_high_b,
       {r6('mw', 4)} AS mean_worse, {r6('mw - hw', 4)} AS ci_low_w, {r6('mw + hw', 4)} AS ci_high_w,
       {r6(p, 4)} AS t_p, {r6('u3.u_p', 4)} AS u_p FROM g2 JOIN u3 ON g2.feature = u3.feature""")


@register("m16_drivers_table", _m16_sql)
def m16_drivers_table(spark, d):
    """Metadata drivers of better / worse R2: means, CIs, Welch and
    Mann-Whitney p per feature (metadata fans out as in the reference)."""
    meta = V.dataset_meta(spark, d).withColumn("cluster", F.explode(F.array(F.lit("cluster_m0"), F.lit("cluster_m1"))))
    w = RL.merge_with_metadata(wide_pairs(spark, d), meta)
    w = RL.quality_filter(RL.quality_filter(w, "r2_unassisted", 0.2, False), "r2_assisted", 0.2, False)
    w = w.withColumn("llm_better", F.col("r2_assisted") > F.col("r2_unassisted"))
    w = w.withColumn("num_categorical_vars", F.col("num_categorical_vars").cast("double"))
    long = RL.melt(w.select("dataset", "llm_better", "subject_variable_ratio", "num_categorical_vars"),
                   ["dataset", "llm_better"], ["subject_variable_ratio", "num_categorical_vars"], "feature", "value")
    ci = ST.summarize_ci(long, ["feature", "llm_better"], "value")
    b = ci.where(F.col("llm_better")).select("feature", F.col("mean").alias("mean_better"),
                                             F.col("ci_low").alias("ci_low_b"), F.col("ci_high").alias("ci_high_b"))
    wo = ci.where(~F.col("llm_better")).select("feature", F.col("mean").alias("mean_worse"),
                                               F.col("ci_low").alias("ci_low_w"), F.col("ci_high").alias("ci_high_w"))
    t = ST.ttest_welch(long, ["feature"], "value", "llm_better").select("feature", F.col("p_value").alias("t_p"))
    u = ST.mannwhitney(long, ["feature"], "value", "llm_better").select("feature", F.col("p_value").alias("u_p"))
    out = b.join(wo, "feature").join(t, "feature").join(u, "feature")
    return out.select("feature", *[_r4(c) for c in out.columns if c != "feature"])
