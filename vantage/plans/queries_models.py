"""Registered queries for K3-K9, K11, K12, K15 (model families, one fit per dataset) and for M8-M11 on their results.

Fits have no DuckDB twin; ``tests/test_trees.py``, ``test_logistic.py`` and
``test_families.py`` hold them against exact searches and known answers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vantage.functions import expr as B
from vantage.operators import cluster as CL
from vantage.operators import families as FM
from vantage.operators import logistic as L
from vantage.operators import models as K
from vantage.operators import trees as T
from vantage.operators import vectors as VX
from vantage.operators.pca import pca
from vantage.plans import duck as D
from vantage.plans import reports as R
from vantage.plans.catalog import register
from vantage.session import checkpoint_dir
from vantage.sources import testdata as V

r6 = D.r6


# ---------------------------------------------------------------- regression, one fit per dataset

def _regressors(spark, d, families=FM.REGRESSORS):
    return FM.Regressors(R.design(V.samples(spark, d)), ["dataset"], "row_key", "x3", R.ASSISTED, families=families)


def _one_family(spark, d, name):
    return _regressors(spark, d, [name]).metrics().select("dataset", "n", "r2", "rmse", "mae")


@register("k3_random_forest")
def k3_random_forest(spark, d):
    """K3: random-forest regressor (100 trees), one per dataset; test metrics."""
    return _one_family(spark, d, "RandomForest")


@register("k4_gradient_boost")
def k4_gradient_boost(spark, d):
    """K4: gradient-boosted regressor (100 rounds, depth 3), one per dataset; test metrics."""
    return _one_family(spark, d, "GradientBoost")


@register("k8_best_of_families")
def k8_best_of_families(spark, d):
    """K8: linear regression, forest and boosting fitted per dataset; the one with the best test R2."""
    return _regressors(spark, d).best()


@register("k12_tree_attributions")
def k12_tree_attributions(spark, d):
    """K12 with K8: the best model per dataset, its metrics and its top 5 features by mean absolute attribution over all rows."""
    return _regressors(spark, d).top_features(5)


# ---------------------------------------------------------------- classification, one fit per group

# Words and letters that tell the languages of the documents apart, as rates per character.
MARKS = {"rate_th": "th", "rate_e_acute": "é", "rate_n_tilde": "ñ", "rate_sch": "sch"}


def _documents(spark, d):
    """All documents with two kinds of columns: rates and lengths, and a size class (missing for some)."""
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    rates = [((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / F.lit(len(m)) / n).alias(c) for c, m in MARKS.items()]
    size = F.when(n < 500, "short").when(n < 5000, "middle").otherwise("long")
    return V.table(spark, d, "documents").select("doc_id", "source", "lang", F.log1p(F.length(text).cast("double")).alias("len_log"), *rates,
                                                 F.when(F.col("doc_id") % 13 != 0, size).alias("size"))


NUMERIC, CATEGORICAL = ["len_log", *MARKS], {"size": ["long", "middle", "short"]}


def _one_classifier(spark, d, name):
    docs = _documents(spark, d)
    pred = FM.classifier_predictions(docs, ["source"], "doc_id", "lang", NUMERIC, CATEGORICAL, families=[name])
    return FM.classifier_scores(pred, ["source"]).select("source", "n", "auc", "rmse", "mae")


@register("k5_logistic")
def k5_logistic(spark, d):
    """K5: logistic regression of the language on document features, one per source: convergence and steps."""
    docs = FM.numbered(_documents(spark, d), ["source"], "lang")
    rows, _ = FM.encoded(docs, ["source"], NUMERIC, CATEGORICAL, F.lit(True))
    m = L.fit_logistic(rows, ["source"], "doc_id", "vec", "_y")
    return m.select("source", F.size("classes").alias("classes"), "loss", "converged")


@register("k6_random_forest_classifier")
def k6_random_forest_classifier(spark, d):
    """K6: random-forest classifier (100 trees) of the language, one per source: one-vs-rest AUC and label errors."""
    return _one_classifier(spark, d, "RandomForest")


@register("k7_gradient_boost_classifier")
def k7_gradient_boost_classifier(spark, d):
    """K7: gradient-boosted classifier (100 rounds, all classes at once) of the language, one per source: one-vs-rest AUC and label errors."""
    return _one_classifier(spark, d, "GradientBoost")


@register("k9_classifier_chain")
def k9_classifier_chain(spark, d):
    """K9: the whole chain (stratified split, imputation, scaling, indicators, SMOTE, three classifiers of four
    languages) per source; the classifier with the best one-vs-rest AUC."""
    scores = FM.classifier_chain(_documents(spark, d), ["source"], "doc_id", "lang", NUMERIC, CATEGORICAL)
    return FM.best_classifier(scores, ["source"])


# The languages in order, and what speaks for each in the score of k11_auc_ovr.
LANGUAGE_MARKS = {"de": "sch", "en": "th", "es": "ñ", "fr": "é"}


def _ovr_sql():
    q = D.CTE()
    count = {lang: f"((length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{m}', ''))) / {float(len(m))} + 1.0)" for lang, m in LANGUAGE_MARKS.items()}
    total = " + ".join(count.values())
    q.add("p", "SELECT source, lang, unnest([" + ", ".join(f"struct_pack(c := '{lang}', p := round({v} / ({total}), 9))" for lang, v in count.items()) + "], recursive := true) FROM documents")
    q.add("a", f"""SELECT source, c, sum(CASE WHEN lang = c THEN r ELSE 0.0 END) AS rp, count(CASE WHEN lang = c THEN 1 END) AS np, count(CASE WHEN lang <> c THEN 1 END) AS nn
       FROM (SELECT source, lang, c, {D.avg_rank_sql('source, c', 'p')} AS r FROM p) t GROUP BY source, c""")
    q.add("b", "SELECT source, CASE WHEN np > 0 AND nn > 0 THEN (rp - np * (np + 1) / 2.0) / (np * nn) END AS auc FROM a")
    return q.sql(f"SELECT source, CASE WHEN count(auc) = count(*) THEN {r6('avg(auc)')} END AS auc FROM b GROUP BY source")


@register("k11_auc_ovr", _ovr_sql)
def k11_auc_ovr(spark, d):
    """One-vs-rest macro AUC over four languages per source, of shares of letter marks."""
    text = F.coalesce("text", F.lit(""))
    count = [(F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / F.lit(float(len(m))) + 1.0 for m in LANGUAGE_MARKS.values()]
    total = count[0] + count[1] + count[2] + count[3]
    docs = V.table(spark, d, "documents").select("source", (F.array_position(F.array(*[F.lit(x) for x in LANGUAGE_MARKS]), F.col("lang")) - 1).alias("y"),
                                                 F.array(*[F.round(c / total, 9) for c in count]).alias("p"))
    return K.auc_ovr(docs, ["source"], "y", "p")


# ---------------------------------------------------------------- M8-M11 on classifiers that were fitted

_WRITTEN: dict[tuple, str] = {}


def cluster_classification(spark, d, assisted=False):
    """The table that M8 to M11 read: ``chain_scores``."""
    return _written(spark, d, f"cluster-classification{'-assisted' if assisted else ''}", lambda: chain_scores(spark, d, assisted))


def cluster_labels(spark, d):
    """``dataset, model, row_id, cluster``: the K-means clusters (k = 3) of each model, the same for both chains."""
    emb = V.emb_long(spark, d)
    return _written(spark, d, "cluster-labels", lambda: CL.kmeans(emb, ["dataset", "model"], "row_id", "embedding", 3)[0].select("dataset", "model", "row_id", "cluster"))


def _written(spark, d, name, made):
    """A table that is made and written once per session and input."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _WRITTEN:
        path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        made().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def chain_scores(spark, d, assisted=False):
    """Scores of the chain for each (dataset, cluster column): the label is the model's K-means cluster (k = 3) of a row, the
    features are its raw columns and, ``assisted``, the first two components of the other models' embeddings."""
    emb, raw = V.emb_long(spark, d), V.emb_raw(spark, d)
    rows = raw.join(cluster_labels(spark, d), ["dataset", "row_id"])
    numeric = ["x1", "x2", "x3"]
    if assisted:
        scores, _ = pca(emb, ["dataset", "model"], "row_id", "embedding", V.EMB_WIDTH, 2)
        wide = scores.groupBy("dataset", "row_id").pivot("model", V.EMB_MODELS).agg(F.first("scores"))
        others = [F.when(F.col("model") != m, F.col(m)[i]).otherwise(0.0).alias(f"{m}_{i}") for m in V.EMB_MODELS for i in (0, 1)]
        rows = rows.join(wide, ["dataset", "row_id"]).select("dataset", "model", "row_id", "cluster", *numeric, *others)
        numeric += [f"{m}_{i}" for m in V.EMB_MODELS for i in (0, 1)]
    rows = rows.select("dataset", F.concat(F.lit("cluster_"), F.col("model")).alias("cluster_column"), "row_id", "cluster", *numeric)
    return FM.classifier_chain(rows, ["dataset", "cluster_column"], "row_id", "cluster", numeric, {})


COLUMN_LABELS = {f"cluster_{m}": f"Model {m[1:]}" for m in V.EMB_MODELS}


def _best_of_chain(scores):
    best = FM.best_classifier(scores, ["dataset", "cluster_column"])
    return best.select("dataset", F.col("cluster_column").alias("cluster"), "best_model", "auc")


def _by_algorithm(scores):
    """``dataset, model, auc``: the mean over cluster columns of each algorithm."""
    return scores.groupBy("dataset", "model").agg(F.avg("auc").alias("auc")).where(F.col("auc").isNotNull())


@register("m8_best_cluster_fitted")
def m8_best_cluster_fitted(spark, d):
    """M8 on fitted classifiers: best cluster column per dataset, then AUC mean / 95% CI per label."""
    return R.best_cluster(_best_of_chain(cluster_classification(spark, d)), COLUMN_LABELS)


@register("m9_auc_significance_fitted")
def m9_auc_significance_fitted(spark, d):
    """M9 on fitted classifiers: AUC mean / SEM by (label, best model) with a label-vs-rest Welch flag."""
    return R.auc_significance(_best_of_chain(cluster_classification(spark, d)), COLUMN_LABELS)


@register("m10_assisted_auc_fitted")
def m10_assisted_auc_fitted(spark, d):
    """M10 on fitted classifiers: AUC by algorithm with and without the embeddings' components."""
    return R.assisted_auc(_by_algorithm(cluster_classification(spark, d, True)), _by_algorithm(cluster_classification(spark, d)))


@register("m11_paired_auc_fitted")
def m11_paired_auc_fitted(spark, d):
    """M11 on fitted classifiers: best AUC per dataset with and without the embeddings' components, in pairs."""
    return R.paired_auc(_by_algorithm(cluster_classification(spark, d, True)), _by_algorithm(cluster_classification(spark, d)))


# ---------------------------------------------------------------- K15

@register("k15_clinical_pipeline")
def k15_clinical_pipeline(spark, d):
    """K15, clustering half: labelled rows -> sentence -> embedding -> 2
    clusters -> silhouette (documents as the table)."""
    from vantage.operators.text import embed_texts
    docs = V.docs(spark, d).withColumn("outcome", B.binarize("quality", 0, "good", "poor"))
    docs = docs.withColumn("sentence", B.row_sentence(["quality", "toxic"], skip=("outcome",)))
    docs = docs.withColumn("sentence", F.concat_ws(" ", "sentence", "lang", "source"))
    e = embed_texts(docs.withColumn("one", F.lit("all")), "sentence", dim=64, key="doc_id")
    a, _, _ = CL.kmeans(e, ["one"], "doc_id", "embedding", 2)
    lab = a.join(e.select("one", "doc_id", "embedding"), ["one", "doc_id"])
    # whole table: squared-Euclidean silhouette from per-cluster sums
    sil = VX.silhouette_sq(lab, ["one"], "embedding", "cluster")
    return sil.drop("one")


@register("k15_clinical_forest")
def k15_clinical_forest(spark, d):
    """K15, supervised half: 80/20 split, scaling, indicators, SMOTE and a forest for the quality label, per language."""
    docs = _documents(spark, d).join(V.table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    docs = docs.withColumn("toxic", F.col("toxic").cast("string"))
    return FM.clinical_forest(docs, ["lang"], "doc_id", "quality", NUMERIC, {**CATEGORICAL, "toxic": ["0", "1"]})
