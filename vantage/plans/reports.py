"""M*: the reference's report queries, each one Spark plan.

The reference recomputes each subset and each statistic in its own pass;
here a subset is a grouping key (``llm_better``, a threshold) and all
statistics of a report come out of one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.functions import dist
from vantage.functions import expr as B
from vantage.operators import features as J
from vantage.operators import models as K
from vantage.operators import relational as RL
from vantage.operators import stats as ST
from vantage.sources import testdata as V

UNASSISTED = ["x1", "cat1_B"]
ASSISTED = ["x1", "cat1_B", "x2", "cat2_Y"]


def design(df: DataFrame) -> DataFrame:
    """Encode the sample table: category indicators (drop-first) + split flag."""
    return df.select("*", J.indicator("cat1", "B").alias("cat1_B"), J.indicator("cat2", "Y").alias("cat2_Y"),
                     J.split_flag(F.col("row_key")).alias("is_test"))


def regression_pairs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4, wide: per dataset the test-set ``n`` and ``r2/rmse/mae`` of the
    unassisted ({x1, cat1}) and assisted ({x1, cat1, x2, cat2}) linear models.

    One aggregate builds the training normal equations of the larger
    design; the smaller one is its sub-matrix and is solved in the same
    projection chain (no join).  The one coefficient row of each dataset is
    joined to its test rows once and both models' errors come out of one
    more aggregate: two scans of the sample table in total.
    """
    s = design(V.samples(spark, sf_dir))
    mom = K.cross_moments(s, ["dataset"], "x3", ASSISTED, where=~F.col("is_test"))
    sub = ["s_0_0", "s_0_1", "s_0_2", "s_1_1", "s_1_2", "s_2_2", "sy_0", "sy_1", "sy_2"]
    ca = K.solve_moments(mom, ["dataset"], [0, 1, 2, 3, 4], ASSISTED, "a_", keep=sub)
    coef = K.solve_moments(ca, ["dataset"], [0, 1, 2], UNASSISTED, "u_",
                           keep=[f"a_{c}" for c in ["intercept", *ASSISTED]]).drop("n")
    test = s.where(F.col("is_test")).select("dataset", "x3", *ASSISTED)
    pred = test.join(coef, "dataset").select(
        "dataset", F.col("x3").alias("y"),
        K.linear_prediction("u_", UNASSISTED).alias("yhat_u"),
        K.linear_prediction("a_", ASSISTED).alias("yhat_a"))
    out = regression_metrics_wide(pred, ["dataset"], "y", {"unassisted": "yhat_u", "assisted": "yhat_a"})
    return materialize(out)


def materialize(df: DataFrame) -> DataFrame:
    """Write a small result table (one row per dataset) once to the shared
    checkpoint folder and cut its lineage, so reports that read it several
    times (per side, per subset, per test) do not recompute the scans and
    fits behind it.  Reliable checkpoint, never ``localCheckpoint``."""
    from vantage.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def regression_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4, long: ``dataset, model, n, r2, rmse, mae`` (one row per model)."""
    w = regression_pairs_wide(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(m).alias("model"), *[F.col(f"{c}_{m}").alias(c) for c in ("r2", "rmse", "mae")])
                     for m in ("unassisted", "assisted")])
    return w.select("dataset", "n", F.inline(rows))


def regression_metrics_wide(pred: DataFrame, by: Sequence[str], y: str, models: dict[str, str]) -> DataFrame:
    """K10 for several prediction columns in one aggregate; wide output
    ``by, n, r2_<m>, rmse_<m>, mae_<m>``."""
    yv = F.col(y)
    aggs = [F.count(F.lit(1)).alias("n"), (F.var_pop(yv) * F.count(F.lit(1))).alias("_sst")]
    for m, c in models.items():
        e = yv - F.col(c)
        aggs += [F.sum(e * e).alias(f"_sse_{m}"), F.avg(F.abs(e)).alias(f"mae_{m}")]
    g = pred.groupBy(*by).agg(*aggs)
    out = [*by, "n"]
    for m in models:
        out += [(F.lit(1.0) - F.try_divide(F.col(f"_sse_{m}"), F.col("_sst"))).alias(f"r2_{m}"),
                F.sqrt(F.col(f"_sse_{m}") / F.col("n")).alias(f"rmse_{m}"), f"mae_{m}"]
    return g.select(*out)


def regression_metrics_multi(pred: DataFrame, by: Sequence[str], y: str, models: dict[str, str]) -> DataFrame:
    """K10 for several prediction columns in one aggregate; long output
    ``by, model, n, r2, rmse, mae``."""
    yv = F.col(y)
    aggs = [F.count(F.lit(1)).alias("n"), (F.var_pop(yv) * F.count(F.lit(1))).alias("_sst")]
    for m, c in models.items():
        e = yv - F.col(c)
        aggs += [F.sum(e * e).alias(f"_sse_{m}"), F.avg(F.abs(e)).alias(f"_mae_{m}")]
    g = pred.groupBy(*by).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(m).alias("model"),
                 (F.lit(1.0) - F.try_divide(F.col(f"_sse_{m}"), F.col("_sst"))).alias("r2"),
                 F.sqrt(F.col(f"_sse_{m}") / F.col("n")).alias("rmse"),
                 F.col(f"_mae_{m}").alias("mae"))
        for m in models])
    return (g.select(*by, "n", F.inline(rows)))


def paired_summary(df: DataFrame, by: Sequence[str], a: str, b: str, conf: float = 0.95,
                   names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """E4 + L4 in one aggregate: mean/CI of each side and the paired t-test
    of ``a - b`` per group."""
    na, nb = names
    va, vb = F.col(a), F.col(b)
    d = va - vb
    g = df.groupBy(*by).agg(
        F.count(d).alias("n"),
        F.avg(va).alias("_ma"), F.stddev_samp(va).alias("_sa"),
        F.avg(vb).alias("_mb"), F.stddev_samp(vb).alias("_sb"),
        F.avg(d).alias("_md"), F.stddev_samp(d).alias("_sd"))
    n = F.col("n")
    g = g.withColumn("_q", F.when(n > 1, dist.col_t_ppf((1.0 + conf) / 2.0, "n - 1")))
    out = [*by, "n"]
    for nm, m, s in ((na, "_ma", "_sa"), (nb, "_mb", "_sb")):
        sem = F.when(n > 1, F.col(s)) / F.sqrt(n.cast("double"))
        out += [F.col(m).alias(f"mean_{nm}"), (sem * F.col("_q")).alias(f"ci_{nm}")]
    t = F.when(n > 1, F.try_divide(F.col("_md"), F.col("_sd") / F.sqrt(n.cast("double"))))
    g2 = g.select(*out, t.alias("t_stat"))
    return g2.withColumn("p_value", F.when(F.col("t_stat").isNotNull(), dist.col_t_sf2("t_stat", "n - 1")))


def side(pairs: DataFrame, model: str, suffix: str, cols: Sequence[str] = ("r2", "rmse", "mae")) -> DataFrame:
    return pairs.where(F.col("model") == model).select("dataset", *[F.col(c).alias(f"{c}_{suffix}") for c in cols])


def segmented_mae(wide_pairs: DataFrame, r2_min: float = 0.2) -> DataFrame:
    """MAE of unassisted vs assisted, datasets with R2 > ``r2_min`` on
    both sides, split by whether the assisted model has the lower MAE."""
    j = wide_pairs.where((F.col("r2_unassisted") > r2_min) & (F.col("r2_assisted") > r2_min))
    j = j.withColumn("llm_better", F.col("mae_assisted") < F.col("mae_unassisted"))
    return paired_summary(j, ["llm_better"], "mae_unassisted", "mae_assisted", names=("unassisted", "assisted"))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """B10 at the sink: round every DOUBLE column (half-up)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


# ---------------------------------------------------------------- derived result tables

# Cluster-column -> display label (one per event-type model).
CLUSTER_LABELS = {"cluster_click": "Click", "cluster_view": "View", "cluster_purchase": "Purchase",
                  "cluster_signup": "Signup", "cluster_error": "Error"}


def classification_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 stand-in: ``dataset, cluster, best_model, auc`` per (dataset, cluster)."""
    s = V.scores(spark, sf_dir)
    g = s.groupBy("dataset", "model").agg(F.avg("auc").alias("auc"), F.avg("distance_correlation").alias("_dc"))
    best = (F.when(F.col("_dc") < 0.2, F.lit("LogisticReg")).when(F.col("_dc") < 0.5, F.lit("RandomForest"))
            .otherwise(F.lit("GradientBoost")))
    return g.select("dataset", F.concat(F.lit("cluster_"), F.col("model")).alias("cluster"),
                    best.alias("best_model"), "auc")


def auc_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(assisted, unassisted) AUC tables ``dataset, model, auc``."""
    s = V.scores(spark, sf_dir)
    g = s.groupBy("dataset", "model").agg(F.avg("auc").alias("a"), F.avg(F.lit(0.5) + F.col("distance_correlation") / 2.0).alias("u"))
    return (g.select("dataset", "model", F.col("a").alias("auc")), g.select("dataset", "model", F.col("u").alias("auc")))


def best_cluster(results: DataFrame, labels: dict[str, str]) -> DataFrame:
    """M8 of a table ``dataset, cluster, auc``: the best cluster column per dataset, then AUC mean / 95% CI per label."""
    c = results.withColumn("auc", B.to_numeric(F.col("auc")))
    best = RL.best_row(RL.drop_missing(c, ["auc"]), ["dataset"], "auc", ["cluster"])
    return ST.summarize_ci(best.withColumn("label", B.map_labels("cluster", labels)), ["label"], "auc")


def auc_significance(results: DataFrame, labels: dict[str, str]) -> DataFrame:
    """M9 of a table ``dataset, cluster, best_model, auc``: AUC mean / SEM by (label, best model) with a label-vs-rest Welch flag."""
    c = results.withColumn("label", B.map_labels("cluster", labels))
    c = RL.drop_missing(c.withColumn("auc", B.to_numeric(F.col("auc"))), ["auc"])
    g = ST.summarize(c, ["label", "best_model"], ["auc"], ["count", "mean", "sem"])
    sig = ST.one_vs_rest_ttest(c, [], "label", "auc").select("label", "p_value", "significant")
    return g.join(sig, "label").select("label", "best_model", F.col("auc_count").alias("n"),
                                       F.col("auc_mean").alias("mean"), F.col("auc_sem").alias("sem"),
                                       "p_value", "significant")


def assisted_auc(asd: DataFrame, un: DataFrame) -> DataFrame:
    """M10 of two tables ``dataset, model, auc``: assisted AUC by algorithm: mean, mean gain over unassisted, quartiles."""
    j = RL.merge_results(asd, un, ["dataset", "model"], ("_assisted", "_unassisted"))
    g = j.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("auc_assisted").alias("mean_assisted"),
                               F.avg(F.col("auc_assisted") - F.col("auc_unassisted")).alias("mean_delta"))
    box = RL.box_stats(asd, ["model"], "auc").select("model", "q1", "median", "q3")
    return g.join(box, "model")


def paired_auc(asd: DataFrame, un: DataFrame) -> DataFrame:
    """M11 of two tables ``dataset, model, auc``: the best AUC per dataset on both sides, both at least 0.6, compared in pairs for all
    datasets and for those where assisted is better."""
    j = RL.best_score(un, ["dataset"], "auc", "auc_unassisted").join(RL.best_score(asd, ["dataset"], "auc", "auc_assisted"), "dataset")
    j = RL.quality_filter(RL.quality_filter(j, "auc_assisted", 0.6, False), "auc_unassisted", 0.6, False)
    j = j.withColumn("llm_better", B.better_flag("auc_unassisted", "auc_assisted"))
    sub = j.withColumn("subset", F.explode(F.when(F.col("llm_better"), F.array(F.lit("all"), F.lit("better_only")))
                                           .otherwise(F.array(F.lit("all")))))
    return paired_summary(sub, ["subset"], "auc_unassisted", "auc_assisted", names=("unassisted", "assisted"))


def wide(pairs: DataFrame) -> DataFrame:
    """Long pairs -> wide (prefer ``regression_pairs_wide``, which needs no join)."""
    return side(pairs, "unassisted", "unassisted").join(side(pairs, "assisted", "assisted"), "dataset")
