"""K*: models and metrics over many datasets at once.

The linear family is solved in its true grouped form: one aggregate pass
builds each group's normal equations (partial aggregation on the map
side, so a hot group costs no more than a cold one), then the p x p
system is solved by Gauss-Jordan elimination written as Column
arithmetic on that single row per group -- p ``select`` steps, no
Python, no driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions import linalg as LA

def _as_exprs(xs) -> dict[str, Column]:
    if isinstance(xs, Mapping):
        return {k: (v if isinstance(v, Column) else F.col(v)) for k, v in xs.items()}
    return {x: F.col(x) for x in xs}


def cross_moments(df: DataFrame, by: Sequence[str], y: str | Column, xs, where: Column | None = None) -> DataFrame:
    """Sufficient statistics of OLS with intercept for each group, centred.

    Output: ``by, n, s_0_0`` (= n), ``s_0_j`` and ``sy_0`` (means), and for
    i, j >= 1 the centred sums of products ``s_i_j (i <= j), sy_i, syy``;
    index 0 is the intercept and 1.. follow ``xs`` order.  Centring inside
    the aggregate (``covar_pop`` merges means and co-moments) keeps the
    result right for columns far from zero.  ``where`` restricts the rows
    (e.g. training rows) without a second scan; rows with a missing value
    in any column do not count.
    """
    ex = _as_exprs(xs)
    cols = [c.cast("double") for c in ex.values()]
    yv = (F.col(y) if isinstance(y, str) else y).cast("double")
    keep = F.lit(True) if where is None else where
    for c in (*cols, yv):
        keep = keep & c.isNotNull()
    cols, yv = [F.when(keep, c) for c in cols], F.when(keep, yv)
    n = F.count(F.when(keep, F.lit(1)))

    def s(a, b):
        return F.covar_pop(a, b) * n

    aggs = [n.alias("n"), n.cast("double").alias("s_0_0"), F.avg(yv).alias("sy_0"), s(yv, yv).alias("syy")]
    for i, a in enumerate(cols, 1):
        aggs += [F.avg(a).alias(f"s_0_{i}"), s(a, yv).alias(f"sy_{i}")]
        aggs += [s(a, b).alias(f"s_{i}_{j}") for j, b in enumerate(cols[i - 1:], i)]
    return df.groupBy(*by).agg(*aggs)


def mask_moments(mom: DataFrame, use: Sequence[Column]) -> DataFrame:
    """Moments of the sub-design that ``use`` (a boolean per feature, in order) picks in each group: the others get zero
    rows and columns, which ``solve_moments`` turns into coefficient 0."""
    out = {}
    for i, a in enumerate(use, 1):
        out[f"sy_{i}"] = F.when(a, F.col(f"sy_{i}")).otherwise(0.0)
        for j, b in enumerate(use[i - 1:], i):
            out[f"s_{i}_{j}"] = F.when(a & b, F.col(f"s_{i}_{j}")).otherwise(0.0)
    return mom.withColumns(out)


def solve_moments(mom: DataFrame, by: Sequence[str], idx: Sequence[int], names: Sequence[str],
                  prefix: str = "b_", keep: Sequence[str] = ()) -> DataFrame:
    """Solve the normal equations of the sub-design ``idx`` (first 0, the intercept).

    The slopes come from the centred system, the intercept from the means.
    Gauss-Jordan without row exchange on the symmetric positive
    semi-definite matrix, one projection per pivot (see
    ``vantage.functions.linalg``).  Collinear columns get coefficient 0.
    Output: ``by, n, keep..., <prefix>intercept, <prefix><name>...``.
    """
    if idx[0] != 0:
        raise ValueError("idx starts with 0, the intercept")
    idx = list(idx[1:])
    p = len(idx)
    means = ["sy_0", *[f"s_0_{i}" for i in idx]]
    q = ", ".join(f"`{c}`" for c in [*by, "n", *keep, *[c for c in means if c not in keep]])
    out_q = ", ".join(f"`{c}`" for c in [*by, "n", *keep])
    # the p projections as one nested statement: analysed once instead of
    # once per step (each DataFrame step re-analyses the growing plan)
    text = f"SELECT {', '.join([q, *LA.normal_equation_inputs(idx)])} FROM {{mom}}"
    for k in range(p):
        text = f"SELECT {q}, {', '.join(LA.gauss_jordan_step(k, p))} FROM ({text}) AS step{k}"
    intercept = " - ".join(["sy_0", *[f"r_{k} * s_0_{i}" for k, i in enumerate(idx)]])
    outs = ", ".join([f"{intercept} AS `{prefix}intercept`", *[f"r_{k} AS `{prefix}{name}`" for k, name in enumerate(names)]])
    return mom.sparkSession.sql(f"SELECT {out_q}, {outs} FROM ({text}) AS solved", mom=mom)


def grouped_ols(df: DataFrame, by: Sequence[str], y: str, xs, where: Column | None = None,
                prefix: str = "b_") -> DataFrame:
    """K1: OLS with intercept per group; one aggregate + one row-wise solve."""
    ex = _as_exprs(xs)
    mom = cross_moments(df, by, y, ex, where)
    return solve_moments(mom, by, list(range(len(ex) + 1)), list(ex), prefix)


def linear_prediction(coef_prefix: str, xs) -> Column:
    """Fitted value from joined coefficient columns ``<prefix>intercept`` ..."""
    ex = _as_exprs(xs)
    out = F.col(coef_prefix + "intercept")
    for name, c in ex.items():
        out = out + F.col(coef_prefix + name) * c.cast("double")
    return out


def ols_fit(df: DataFrame, by: Sequence[str], y: str, xs, where: Column | None = None) -> DataFrame:
    """K2: coefficients joined back, with ``fitted`` and ``resid`` per row."""
    coef = grouped_ols(df, by, y, xs, where).drop("n")
    out = df.join(coef, list(by), "inner")
    fitted = linear_prediction("b_", xs)
    return out.withColumn("fitted", fitted).withColumn("resid", F.col(y) - F.col("fitted"))


def regression_metrics(pred: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """``n, r2, rmse, mae`` per group.

    R2 is 1 - SSE/SST around the group's own mean (the scikit-learn
    score, not the squared correlation of ``regr_r2``).
    """
    e = F.col(y) - F.col(yhat)
    g = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
        F.avg(F.abs(e)).alias("mae"),
    )
    return g.select(*by, "n",
                    (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"),
                    F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
                    "mae")


def best_by(df: DataFrame, by: Sequence[str], metric: str, order_col: str, higher_is_better: bool = True) -> DataFrame:
    """K8/K9 selection: the best row per group; ties go to the smallest ``order_col``
    (the first model tried wins, as a strict ``>`` scan does)."""
    m = F.col(metric)
    key = F.struct((m if higher_is_better else -m).alias("k"), (-F.col(order_col)).alias("o"))
    cols = [c for c in df.columns if c not in by]
    best = df.where(m.isNotNull()).groupBy(*by).agg(F.max_by(F.struct(*cols), key).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in cols])


def auc(pred: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """K11 (binary): ROC AUC per group from average ranks,
    (R+ - n+(n+ + 1)/2) / (n+ n-).  Ties count one half.  NULL when a
    group has only one class."""
    from vantage.operators.stats import avg_rank

    src = pred.select(*by, F.col(label).cast("int").alias("_y"), F.col(score).cast("double").alias("_s"))
    r = avg_rank(src.where(F.col("_s").isNotNull()), by, "_s", "_r", distributed=True)
    g = r.groupBy(*by).agg(F.sum(F.when(F.col("_y") == 1, F.col("_r")).otherwise(0.0)).alias("_rp"),
                           F.count(F.when(F.col("_y") == 1, 1)).alias("n_pos"),
                           F.count(F.when(F.col("_y") != 1, 1)).alias("n_neg"))
    np_, nn = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    a = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), (F.col("_rp") - np_ * (np_ + 1) / 2.0) / (np_ * nn))
    return g.select(*by, "n_pos", "n_neg", a.alias("auc"))


def auc_ovr(pred: DataFrame, by: Sequence[str], label: str, probs: str, classes: str | None = None) -> DataFrame:
    """K11 (multi-class): one-vs-rest macro AUC.  ``probs`` is an array
    column of class probabilities indexed by the integer label; with a column
    ``classes`` only that many of them count.  NULL when a class has no row
    (or all rows), with two classes the usual AUC."""
    p = F.col(probs) if classes is None else F.slice(probs, 1, F.col(classes).cast("int"))
    ex = pred.select(*by, F.col(label).cast("int").alias("_y"), F.posexplode(p).alias("_class", "_p"))
    ex = ex.withColumn("_pos", (F.col("_y") == F.col("_class")).cast("int"))
    per = auc(ex, [*by, "_class"], "_pos", "_p")
    return per.groupBy(*by).agg(F.when(F.count(F.col("auc")) == F.count(F.lit(1)), F.avg("auc")).alias("auc"))


def linear_attribution(df: DataFrame, coef: DataFrame, by: Sequence[str], xs: Sequence[str],
                       prefix: str = "b_") -> DataFrame:
    """K12 (linear): mean |beta_j (x_j - mean x_j)| per feature and group,
    long form ``by, feature, importance``."""
    by = list(by)
    means = df.groupBy(*by).agg(*[F.avg(x).alias(f"_m_{x}") for x in xs])
    j = df.join(coef, by).join(means, by)
    att = j.groupBy(*by).agg(*[F.avg(F.abs(F.col(prefix + x) * (F.col(x) - F.col(f"_m_{x}")))).alias(x) for x in xs])
    return att.unpivot(by, list(xs), "feature", "importance")


def top_features(att: DataFrame, by: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most important features per group, as text."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(F.col("importance").desc(), "feature")
    top = att.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("_rn", "feature")))
    return top.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda s: s["feature"]), ", ").alias("top_features"))


def inverse_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = (), iters: int = 60) -> DataFrame:
    """Least-squares fit of y = a / (x + b), start a = b = 1, by
    Levenberg-Marquardt (the damped Gauss-Newton of ``curve_fit``).

    Each iteration is one grouped aggregate at the candidate parameters:
    SSE, J'J and J'r.  A candidate that lowers the SSE becomes the best
    point (damping / 10), otherwise the damping grows x 10; the next
    candidate solves (J'J + lam diag(J'J)) d = J'r at the best point.  The
    parameter table (one row per group) is checkpointed to the session's
    shared folder every few iterations, where the fit also ends once no
    group moves by more than 1e-10 of its parameters.  The input is written
    there once and not read again.  Output: ``by, a, b, sse, converged``; the
    flag is false if the iterations ran out or the parameters ran away (data
    without an optimum).
    """
    from vantage.session import checkpoint_dir

    by = list(by)
    checkpoint_dir(df.sparkSession)
    data = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).checkpoint()
    keys = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    big = F.lit(float("inf"))
    st = keys.select(*by, F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(1e-3).alias("lam"),
                     big.alias("best_sse"), F.lit(1.0).alias("best_a"), F.lit(1.0).alias("best_b"),
                     *[F.lit(0.0).alias(c) for c in ["baa", "bab", "bbb", "bar", "bbr"]])
    for i in range(iters):
        j = data.join(st, by) if by else _attach(data, st)
        den = F.col("_x") + F.col("b")
        ja, jb = 1.0 / den, -F.col("a") / (den * den)
        r = F.col("_y") - F.col("a") / den
        state_cols = ["a", "b", "lam", "best_sse", "best_a", "best_b", "baa", "bab", "bbb", "bar", "bbr"]
        g = j.groupBy(*by, *state_cols).agg(
            F.sum(r * r).alias("sse"), F.sum(ja * ja).alias("aa"), F.sum(ja * jb).alias("ab"),
            F.sum(jb * jb).alias("bb"), F.sum(ja * r).alias("ar"), F.sum(jb * r).alias("br"))
        better = F.col("sse").isNotNull() & ~F.isnan("sse") & (F.col("sse") < F.col("best_sse"))
        pick = lambda new, old: F.when(better, F.col(new)).otherwise(F.col(old))
        g = g.select(*by, pick("a", "best_a").alias("best_a"), pick("b", "best_b").alias("best_b"),
                     pick("sse", "best_sse").alias("best_sse"), pick("aa", "baa").alias("baa"),
                     pick("ab", "bab").alias("bab"), pick("bb", "bbb").alias("bbb"), pick("ar", "bar").alias("bar"),
                     pick("br", "bbr").alias("bbr"),
                     F.when(better, F.col("lam") / 10.0).otherwise(F.col("lam") * 10.0).alias("lam"))
        m11 = F.col("baa") * (1.0 + F.col("lam"))
        m22 = F.col("bbb") * (1.0 + F.col("lam"))
        det = m11 * m22 - F.col("bab") * F.col("bab")
        da = F.coalesce(F.try_divide(m22 * F.col("bar") - F.col("bab") * F.col("bbr"), det), F.lit(0.0))
        db = F.coalesce(F.try_divide(m11 * F.col("bbr") - F.col("bab") * F.col("bar"), det), F.lit(0.0))
        st = g.select(*by, (F.col("best_a") + da).alias("a"), (F.col("best_b") + db).alias("b"), "lam", "best_sse",
                      "best_a", "best_b", "baa", "bab", "bbb", "bar", "bbr",
                      F.greatest(F.abs(da) / (F.abs("best_a") + 1e-12), F.abs(db) / (F.abs("best_b") + 1e-12)).alias("step"))
        if i % 5 == 4:
            st = st.checkpoint()
            if st.where("step > 1e-10").isEmpty():
                break
    done = F.coalesce((F.col("step") <= 1e-10) & (F.abs("best_a") < 1e12) & (F.abs("best_b") < 1e12), F.lit(False))
    return st.select(*by, F.col("best_a").alias("a"), F.col("best_b").alias("b"), F.col("best_sse").alias("sse"), done.alias("converged"))


def fit_pooled(train: DataFrame, features: Sequence[str], label: str, kind: str, task: str = "regression",
               seed: int = 42):
    """K3-K7: one MLlib model over all training rows (dataset indicators can
    be among ``features``).  Returns the fitted pipeline model.

    ``kind``: 'rf' (100 trees), 'gbt' (100 rounds, depth 3, step 0.1 --
    the scikit-learn defaults), 'logreg' (500 iterations, L2 = 1/n as
    scikit-learn's C = 1).  Multi-class GBT goes through OneVsRest;
    'gbt_binary' fits labels 0 / 1 directly (one model, not two mirrored).
    """
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as C
    from pyspark.ml import regression as Rg
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    if task == "regression":
        est = {"rf": Rg.RandomForestRegressor(numTrees=100, seed=seed, labelCol=label),
               "gbt": Rg.GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed, labelCol=label),
               "linear": Rg.LinearRegression(labelCol=label)}[kind]
    else:
        n = train.count()
        est = {"rf": C.RandomForestClassifier(numTrees=100, seed=seed, labelCol=label),
               "gbt": C.OneVsRest(classifier=C.GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed),
                                  labelCol=label),
               "gbt_binary": C.GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed, labelCol=label),
               "logreg": C.LogisticRegression(maxIter=500, regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                                              standardization=False, family="auto", labelCol=label)}[kind]
    return Pipeline(stages=[va, est]).fit(train)


def _attach(df, one_row):
    from vantage.operators.relational import attach
    return attach(df, one_row)
