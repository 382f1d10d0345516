"""E1-E4 summaries and L2-L10 statistical tests, grouped by any ``by``.

Each test is one aggregate (moments or rank sums) per group followed by
the L1 distribution functions on that single row, so the cost is one
scan plus a tiny projection no matter how many groups there are.
Conventions follow pandas/SciPy: sample standard deviation (n - 1),
NULL where SciPy returns NaN (one-row groups, constant columns).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.functions import dist

def _null_d():
    return F.lit(None).cast("double")


def _nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def summarize(df: DataFrame, by: Sequence[str], metrics: Sequence[str],
              stats: Sequence[str] = ("mean", "std")) -> DataFrame:
    """Grouped mean / std / sem / count per metric, ``<metric>_<stat>``.

    Rows with a NULL key are dropped (pandas ``groupby``); NaN values are
    skipped like NULL.
    """
    fns = {
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c),
        "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
        "count": lambda c: F.count(c),
        "min": lambda c: F.min(c),
        "max": lambda c: F.max(c),
    }
    src = df
    for k in by:
        src = src.where(F.col(k).isNotNull())
    aggs = [fns[s](_nan_to_null(F.col(m))).alias(f"{m}_{s}") for m in metrics for s in stats]
    return src.groupBy(*by).agg(*aggs)


def summarize_ci(df: DataFrame, by: Sequence[str], metric: str, conf: float = 0.95,
                 prefix: str | None = None) -> DataFrame:
    """``n, mean, std, sem, ci`` (half-width), ``ci_low, ci_high``.

    ``ci = sem * t_{(1+conf)/2, n-1}``; one-row groups get NULL spread.
    """
    p = "" if prefix is None else prefix
    v = _nan_to_null(F.col(metric))
    src = df
    for k in by:
        src = src.where(F.col(k).isNotNull())
    g = src.groupBy(*by).agg(F.count(v).alias("_n"), F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"))
    return ci_columns(g, by, "_n", "_m", "_s", conf, p)


def ci_columns(g: DataFrame, keep: Sequence[str], n: str, m: str, s: str, conf: float, p: str) -> DataFrame:
    nn = F.col(n)
    g = g.withColumn("_q", F.when(nn > 1, dist.col_t_ppf((1.0 + conf) / 2.0, f"`{n}` - 1")))
    sd = F.when(nn > 1, F.col(s))
    sem = sd / F.sqrt(nn.cast("double"))
    half = sem * F.col("_q")
    out = g.select(*keep, nn.alias(f"{p}n"), F.col(m).alias(f"{p}mean"), sd.alias(f"{p}std"),
                   sem.alias(f"{p}sem"), F.when(nn > 1, half).alias(f"{p}ci"))
    return out.select("*", (F.col(f"{p}mean") - F.col(f"{p}ci")).alias(f"{p}ci_low"),
                      (F.col(f"{p}mean") + F.col(f"{p}ci")).alias(f"{p}ci_high"))


def ttest_paired(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """L4: paired t-test of ``a`` against ``b`` (d = a - b), two-sided."""
    d = F.col(a) - F.col(b)
    g = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd"))
    t = F.try_divide(F.col("mean_diff"), F.col("_sd") / F.sqrt(F.col("n").cast("double")))
    out = g.select(*by, "n", "mean_diff", F.when(F.col("n") > 1, t).alias("t_stat"))
    return out.withColumn("p_value", F.when(F.col("t_stat").isNotNull(), dist.col_t_sf2("t_stat", "n - 1")))


def welch_from_moments(n1, m1, v1, n2, m2, v2) -> tuple[Column, Column]:
    """Welch t and Welch-Satterthwaite df from two groups' moments."""
    a = v1 / n1
    b = v2 / n2
    t = F.try_divide(m1 - m2, F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1))
    ok = (n1 > 1) & (n2 > 1)
    return F.when(ok, t), F.when(ok, dof)


def ttest_welch(df: DataFrame, by: Sequence[str], value: str, flag: str) -> DataFrame:
    """Welch t-test of ``value`` where ``flag`` is true against where it is false."""
    v = F.col(value)
    f = F.col(flag)
    g = df.groupBy(*by).agg(
        F.count(F.when(f, v)).alias("n_true"), F.avg(F.when(f, v)).alias("mean_true"),
        F.var_samp(F.when(f, v)).alias("_v1"),
        F.count(F.when(~f, v)).alias("n_false"), F.avg(F.when(~f, v)).alias("mean_false"),
        F.var_samp(F.when(~f, v)).alias("_v2"))
    t, dof = welch_from_moments(F.col("n_true"), F.col("mean_true"), F.col("_v1"),
                                F.col("n_false"), F.col("mean_false"), F.col("_v2"))
    out = g.select(*by, "n_true", "mean_true", "n_false", "mean_false", t.alias("t_stat"), dof.alias("dof"))
    return out.withColumn("p_value", F.when(F.col("t_stat").isNotNull() & (F.col("dof") >= 1),
                                            dist.col_t_sf2("t_stat", "dof")))


def one_vs_rest_ttest(df: DataFrame, by: Sequence[str], group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Welch test of each ``group`` against all other rows of its ``by`` partition.

    One aggregate per (by, group); the "rest" moments are the partition
    totals minus the group's own (count, sum and sum of squares of the
    deviations from the partition's mean, so that nothing cancels far from
    zero); there is no second scan per group.
    """
    v = _nan_to_null(F.col(value))
    g = df.groupBy(*by, group).agg(F.count(v).alias("_n"), F.avg(v).alias("_m"), F.var_samp(v).alias("_var"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    g = g.withColumn("_tn", F.sum("_n").over(w))
    g = g.withColumn("_tm", F.sum(F.col("_m") * F.col("_n") / F.col("_tn")).over(w))
    g = g.withColumn("_s", F.coalesce(F.col("_n") * (F.col("_m") - F.col("_tm")), F.lit(0.0)))
    g = g.withColumn("_ss", F.coalesce(F.col("_var") * (F.col("_n") - 1), F.lit(0.0)) + F.coalesce(F.col("_s") * (F.col("_m") - F.col("_tm")), F.lit(0.0)))
    g = g.withColumn("_ts", F.sum("_s").over(w)).withColumn("_tss", F.sum("_ss").over(w))
    rn = F.col("_tn") - F.col("_n")
    rs = F.col("_ts") - F.col("_s")
    rss = F.col("_tss") - F.col("_ss")
    rd = F.try_divide(rs, rn.cast("double"))
    rm = F.col("_tm") + rd
    rv = F.try_divide(rss - rn * rd * rd, (rn - 1).cast("double"))
    t, dof = welch_from_moments(F.col("_n"), F.col("_m"), F.col("_var"), rn, rm, F.greatest(rv, F.lit(0.0)))
    out = g.select(*by, group, F.col("_n").alias("n"), F.col("_m").alias("mean"), rn.alias("n_rest"),
                   rm.alias("mean_rest"), t.alias("t_stat"), dof.alias("dof"))
    out = out.withColumn("p_value", F.when(F.col("t_stat").isNotNull() & (F.col("dof") >= 1),
                                           dist.col_t_sf2("t_stat", "dof")))
    return out.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


#: Rows of a chunk that ranks and quantiles aim at; a group has at least ``buckets`` chunks.
CHUNK_ROWS = 100_000


def _chunk_bounds(df: DataFrame, by: Sequence[str], v: Column, buckets: int) -> DataFrame:
    """One row per group: ``_b`` (approximate quantiles of ``v``), ``_q_lo``, ``_q_hi``, ``_q_n``."""
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    return df.groupBy(*by).agg(F.percentile_approx(v, probs, 1000).alias("_b"), F.min(v).alias("_q_lo"),
                               F.max(v).alias("_q_hi"), F.count(v).alias("_q_n"))


def _chunk_of(v: Column, buckets: int, chunk_rows: int) -> Column:
    """Number of the chunk of ``v``, rising with it: the quantile bucket and,
    in a group of more than ``buckets * chunk_rows`` rows, the equal-width
    part of that bucket, as many parts as bring it down to ``chunk_rows``.
    Equal values share a chunk; infinite bounds leave a bucket whole but for
    its largest value."""
    at = F.size(F.filter("_b", lambda b: b < v))
    lo, hi = F.coalesce(F.get("_b", at - 1), F.col("_q_lo")), F.coalesce(F.get("_b", at), F.col("_q_hi"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_q_n") / float(buckets * chunk_rows))).cast("bigint")
    share = F.try_divide(v - lo, hi - lo)
    inner = F.when(F.isnan(share) | share.isNull(), F.lit(0)).otherwise(F.least(parts - 1, F.floor(share * parts).cast("bigint")))
    return at * parts + F.when(v >= hi, parts - 1).otherwise(inner)


def avg_rank(df: DataFrame, by: Sequence[str], col: str, out: str = "rank", distributed: bool = False,
             buckets: int = 64, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """average rank with ties (1-based), per group; NULL values get NULL.

    ``distributed=False``: one window per group -- right for aggregated rows
    (one per dataset or model).  ``distributed=True``: exact ranks without
    sorting a whole group in one task, for raw rows where one group can hold
    a third of the data: each group's values are cut into ``buckets``
    chunks at approximate quantiles (more in a group with more than
    ``buckets * chunk_rows`` rows), each (group, chunk) is ranked locally
    (the chunks of a hot group spread over many tasks), and the row counts
    of the group's lower chunks are added as an offset (a prefix sum over a
    table of groups x buckets).
    """
    part = list(by)
    if not distributed:
        w = Window.partitionBy(*part).orderBy(F.col(col).asc_nulls_last())
        wt = Window.partitionBy(*part, col)
        return (df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0)
                  .withColumn(out, F.when(F.col(col).isNotNull(), F.col(out))))
    valid = df.where(F.col(col).isNotNull())
    # data-defined chunks: each group's values cut at approximate quantiles
    # (one partial aggregate); equal values always share a chunk, so the
    # ranks are exact whatever the boundaries are
    v = F.col(col).cast("double")
    bounds = _chunk_bounds(valid, part, v, buckets)
    # one row per group: AQE broadcasts it when its measured size is small
    r = valid.join(bounds, part) if part else _attach(valid, bounds)
    r = r.withColumn("_pid", _chunk_of(v, buckets, chunk_rows)).drop("_b", "_q_lo", "_q_hi", "_q_n")
    chunk = [*part, "_pid"]
    counts = r.groupBy(*chunk).agg(F.count(F.lit(1)).alias("_c"))
    wo = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(1))).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(wo), F.lit(0))).drop("_c")
    # ranks from counts of distinct values: a running sum over the distinct
    # values of a chunk (not its rows), joined back on (group, chunk, value);
    # a value shared by a huge number of rows is one counted row here
    ties = r.groupBy(*chunk, col).agg(F.count(F.lit(1)).alias("_tv"))
    wc = Window.partitionBy(*chunk).orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ties = ties.withColumn("_cum", F.sum("_tv").over(wc)).join(offsets, chunk)
    ties = ties.select(*chunk, col, (F.col("_off") + F.col("_cum") - (F.col("_tv") - 1) / 2.0).alias(out))
    ranked = r.join(ties, [*chunk, col]).drop("_pid")
    nulls = df.where(F.col(col).isNull()).withColumn(out, F.lit(None).cast("double"))
    return ranked.unionByName(nulls)


def distinct_value_ranks(counts: DataFrame, by: Sequence[str], value: str, count: str, out: str,
                         buckets: int = 64, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Average rank of each distinct ``value`` of a group, from a table with
    one row per (by, value) and its row ``count``.

    The distinct values are cut into chunks at approximate quantiles, summed
    up inside each chunk and shifted by the counts of the lower chunks, so
    neither a repeated value nor a large group is sorted in one task.  NULL
    group keys form a group of their own.
    """
    part = list(by)
    v = F.col(value).cast("double")
    r = _join_groups(counts, _chunk_bounds(counts, part, v, buckets), part)
    r = r.withColumn("_pid", _chunk_of(v, buckets, chunk_rows)).drop("_b", "_q_lo", "_q_hi", "_q_n")
    below = Window.partitionBy(*(part or [F.lit(1)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = r.groupBy(*part, "_pid").agg(F.sum(count).alias("_c"))
    offsets = offsets.select(*part, "_pid", F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_off"))
    upto = Window.partitionBy(*part, "_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = _join_groups(r.withColumn("_cum", F.sum(count).over(upto)), offsets, [*part, "_pid"])
    return r.withColumn(out, F.col("_off") + F.col("_cum") - (F.col(count) - 1) / 2.0).drop("_pid", "_cum", "_off")


def _join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where NULL equals NULL; without keys ``right`` is one row."""
    if not keys:
        return _attach(left, right)
    right = right.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    on = [left[k].eqNullSafe(right[f"_key_{i}"]) for i, k in enumerate(keys)]
    return left.join(right, on).drop(*[f"_key_{i}" for i in range(len(keys))])


def pearson_from(df: DataFrame, by: Sequence[str], x: Column, y: Column) -> DataFrame:
    g = df.groupBy(*by).agg(
        F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"),
        F.covar_pop(x, y).alias("_c"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"))
    r = F.try_divide(F.col("_c"), F.col("_sx") * F.col("_sy"))
    r = F.when((F.col("_sx") > 0) & (F.col("_sy") > 0), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    out = g.select(*by, "n", r.alias("r"))
    t = F.col("r") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1.0 - F.col("r") * F.col("r")))
    out = out.withColumn("_t", F.when((F.abs(F.col("r")) < 1.0) & (F.col("n") >= 3), t))
    p = (F.when(F.col("r").isNull() | (F.col("n") < 3), _null_d())
         .when(F.abs(F.col("r")) >= 1.0, F.lit(0.0))
         .otherwise(dist.col_t_sf2("_t", "n - 2")))
    return out.withColumn("p_value", p).drop("_t")


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """L2: Pearson r and two-sided p; NULL for a constant column."""
    return pearson_from(df, by, F.col(x).cast("double"), F.col(y).cast("double"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, distributed: bool = True) -> DataFrame:
    """L3: Spearman rho = Pearson r of the average ranks (rows with a NULL dropped)."""
    src = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    src = avg_rank(avg_rank(src, by, x, "_rx", distributed), by, y, "_ry", distributed)
    return pearson_from(src, by, F.col("_rx"), F.col("_ry")).withColumnRenamed("r", "rho")


def _exact_signed_rank_cdf(n: Column, w: Column) -> Column:
    """P(W <= w) under H0 for the signed-rank statistic, by DP over rank sums."""
    size = n * (n + 1) / 2 + 1
    init = F.transform(F.sequence(F.lit(0), (size - 1).cast("int")),
                       lambda s: F.when(s == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    counts = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")), init,
        lambda acc, k: F.transform(acc, lambda c, s: c + F.when(s >= k, acc[s - k]).otherwise(F.lit(0.0))))
    below = F.aggregate(F.slice(counts, 1, (F.floor(w) + 1).cast("int")), F.lit(0.0), lambda a, c: a + c)
    return below / F.pow(F.lit(2.0), n.cast("double"))


def wilcoxon(df: DataFrame, by: Sequence[str], a: str, b: str, exact_max_n: int = 50) -> DataFrame:
    """Wilcoxon signed-rank test of a - b (zero differences dropped).

    ``W = min(W+, W-)``.  Exact null law when n <= ``exact_max_n`` and no
    ties among |d| (SciPy's 'auto'), else the normal law with tie
    correction and no continuity correction.  Rows are counted per distinct
    |d| first; only those counts are ranked, chunk by chunk.
    """
    by = list(by)
    d = F.col(a) - F.col(b)
    counts = df.where(d.isNotNull() & (d != 0)).groupBy(*by, F.abs(d).alias("_ad")).agg(
        F.count(F.when(d > 0, 1)).alias("_np"), F.count(F.when(d < 0, 1)).alias("_nn"), F.count(F.lit(1)).alias("_t"))
    g = distinct_value_ranks(counts, by, "_ad", "_t", "_r").groupBy(*by).agg(
        F.sum("_t").alias("n"), F.sum(F.col("_np") * F.col("_r")).alias("w_plus"),
        F.sum(F.col("_nn") * F.col("_r")).alias("w_minus"),
        F.sum(F.pow(F.col("_t"), 3) - F.col("_t")).alias("_tie"), F.max("_t").alias("_maxt"))
    n = F.col("n").cast("double")
    stat = F.least(F.col("w_plus"), F.col("w_minus"))
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tie") / 48.0
    z = F.try_divide(stat - mean, F.sqrt(var))
    g = g.select("*", stat.alias("statistic"), z.alias("_z"), var.alias("_var"))
    exact = F.least(F.lit(1.0), 2.0 * _exact_signed_rank_cdf(F.col("n"), F.col("statistic")))
    use_exact = (F.col("n") <= exact_max_n) & (F.col("_maxt") == 1)
    p = F.when(use_exact, exact).otherwise(F.when(F.col("_var") > 0, dist.col_norm_sf2("_z")))
    return g.select(*by, "n", "statistic", p.alias("p_value"))


#: The exact law of U is used (``method="auto"``) up to this size of the smaller group and this many possible values.
EXACT_SMALLER, EXACT_VALUES = 8, 20_000


def u_law_tail(n1: int, n2: int, u: float) -> float:
    """P(U >= u) of the Mann-Whitney statistic without ties.

    The number of ways to reach U = k is the k-th coefficient of the Gaussian
    binomial (n1 + n2 over n1), built up by its recurrence: for i = 1 .. n1,
    times (1 - q^(n2 + i)), divided by (1 - q^i).
    """
    import math

    import numpy as np

    small, large = min(n1, n2), max(n1, n2)
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1.0
    for i in range(1, small + 1):
        if large + i <= n1 * n2:
            ways[large + i:] -= ways[:-(large + i)].copy()
        for r in range(i):  # running sums in steps of i
            ways[r::i] = np.cumsum(ways[r::i])
    at = math.ceil(u - 1e-9)
    upper = ways[at:].sum() if at <= n1 * n2 else 0.0
    return float(upper / math.comb(n1 + n2, n1))


def mannwhitney(df: DataFrame, by: Sequence[str], value: str, flag: str, method: str = "asymptotic") -> DataFrame:
    """Mann-Whitney U of ``value`` for flag true (x) against false (y).

    U = R_x - n_x(n_x+1)/2; two-sided normal law with tie and continuity
    correction (SciPy's asymptotic method).  Rows are counted per distinct
    value first; only those counts are ranked, chunk by chunk.  With
    ``method="exact"`` the law is that of all orders of distinct values (ties
    are not allowed for), with ``"auto"`` so for groups without ties of which
    the smaller has at most eight rows, else the normal law; both add a column
    ``method`` that says which law a row's ``p_value`` is from.
    """
    if method not in ("asymptotic", "exact", "auto"):
        raise ValueError(method)
    by = list(by)
    f = F.col(flag)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(
        F.count(F.when(f, 1)).alias("_nx"), F.count(F.when(~f, 1)).alias("_ny"), F.count(F.lit(1)).alias("_t"))
    g = distinct_value_ranks(counts, by, "_v", "_t", "_r").groupBy(*by).agg(
        F.sum("_nx").alias("n_true"), F.sum("_ny").alias("n_false"),
        F.sum(F.col("_nx") * F.col("_r")).alias("_rx"),
        F.sum(F.pow(F.col("_t"), 3) - F.col("_t")).alias("_tie"))
    n1 = F.col("n_true").cast("double")
    n2 = F.col("n_false").cast("double")
    nn = n1 + n2
    u1 = F.col("_rx") - n1 * (n1 + 1) / 2.0
    big = F.greatest(u1, n1 * n2 - u1)
    sigma = F.sqrt(n1 * n2 / 12.0 * ((nn + 1) - F.try_divide(F.col("_tie"), nn * (nn - 1))))
    z = F.try_divide(big - n1 * n2 / 2.0 - 0.5, sigma)
    ok = (F.col("n_true") > 0) & (F.col("n_false") > 0) & (sigma > 0)
    g = g.select(*by, "n_true", "n_false", u1.alias("u_stat"), F.when(ok, z).alias("_z"), (F.col("_tie") == 0).alias("_whole"))
    normal = F.when(F.col("_z").isNotNull(), F.least(F.lit(1.0), dist.col_norm_sf2("_z")))
    if method == "asymptotic":
        return g.select(*by, "n_true", "n_false", "u_stat", normal.alias("p_value"))
    from vantage.session import ship_package

    ship_package(df.sparkSession)

    @F.pandas_udf("double")
    def exact(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:  # one row a group
        return pd.Series([min(1.0, 2 * u_law_tail(int(a), int(b), max(c, a * b - c))) if a > 0 and b > 0 else None for a, b, c in zip(n1, n2, u)], dtype="float64")

    both = (F.col("n_true") > 0) & (F.col("n_false") > 0)
    small = F.col("_whole") & (F.least("n_true", "n_false") <= EXACT_SMALLER) & (F.col("n_true") * F.col("n_false") <= EXACT_VALUES)
    use = both if method == "exact" else both & small
    g = g.withColumn("method", F.when(use, "exact").otherwise("asymptotic"))
    by_law = lambda m: g.where(F.col("method") == m)
    a = by_law("exact").withColumn("p_value", exact("n_true", "n_false", "u_stat"))
    b = by_law("asymptotic").withColumn("p_value", normal)
    cols = [*by, "n_true", "n_false", "u_stat", "p_value", "method"]
    return a.select(*cols).unionByName(b.select(*cols))


def breusch_pagan(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Breusch-Pagan test (statsmodels ``het_breuschpagan`` with a constant).

    Fit y ~ xs per group, regress the squared residuals on the same
    regressors, LM = n * R^2 of that fit, p from chi-square with len(xs)
    degrees of freedom.  One join of the coefficients, one row per group, to
    the rows; R^2 of the second fit comes from its moments (slopes times
    centred cross products over the centred sum of squares).
    """
    from vantage.operators import models as K

    by = list(by)
    xs = list(xs)
    coef = K.grouped_ols(df, by, y, xs, prefix="b_").drop("n")
    res = _join_groups(df, coef, by).select(*by, *xs, F.pow(F.col(y) - K.linear_prediction("b_", xs), 2).alias("_u"))
    prods = [f"sy_{i}" for i in range(1, len(xs) + 1)]
    fit = K.solve_moments(K.cross_moments(res, by, "_u", xs), by, list(range(len(xs) + 1)), xs, "a_", keep=["syy", *prods])
    explained = sum((F.col(f"a_{x}") * F.col(c) for x, c in zip(xs, prods)), F.lit(0.0))
    fit = fit.withColumn("lm_stat", F.col("n") * F.try_divide(explained, F.col("syy")))
    return fit.select(*by, "n", "lm_stat", dist.col_chi2_sf("lm_stat", len(xs)).alias("p_value"))


def regression_line(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """L10 (line): least-squares slope and intercept of y on x."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
                               F.regr_intercept(y, x).alias("intercept"))


def regression_band(df: DataFrame, by: Sequence[str], x: str, y: str, key: str, reps: int = 200,
                    grid: int = 100, level: float = 0.95, seed: int = 42) -> DataFrame:
    """L10 (band): bootstrap band of the regression line (what ``regplot`` draws).

    Each replicate resamples rows with Poisson(1) weights drawn from a hash
    of (row key, replicate), so no row is ever copied: every row emits one
    vector of its weighted sums for all replicates (w, wx, wy, wxx, wxy per
    replicate) and a single ``Summarizer.sum`` per group adds them up -- one
    pass over the data.  The replicate lines are evaluated on a ``grid``
    over [min x, max x]; the band is the (1 - level)/2 and (1 + level)/2
    percentiles over replicates (aggregated rows only).
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    by = list(by)
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    # Poisson(1) by inverting its CDF at a hashed uniform
    cdf, term, steps = [], 0.36787944117144233, 0.0
    for k in range(10):
        steps += term
        cdf.append(steps)
        term /= (k + 1)

    def weight(r):
        u = (F.abs(F.xxhash64(F.col(key).cast("string"), r, F.lit(seed))) % 1000003) / 1000003.0
        return F.aggregate(F.array(*[F.lit(c) for c in cdf]), F.lit(0.0),
                           lambda acc, c: acc + F.when(u > c, 1.0).otherwise(0.0))

    ws = F.transform(F.sequence(F.lit(1), F.lit(reps)), weight)
    # sums around the group's means, so that numbers far from zero lose nothing
    src = df.where(xs.isNotNull() & ys.isNotNull()).select(*by, F.col(key), xs.alias("_x"), ys.alias("_y"))
    mid = src.groupBy(*by).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    src = src.join(mid, by) if by else _attach(src, mid)
    dx, dy = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
    parts = F.flatten(F.transform(ws, lambda w: F.array(w, w * dx, w * dy, w * dx * dx, w * dx * dy)))
    g = src.groupBy(*by, "_mx", "_my").agg(vector_to_array(Summarizer.sum(array_to_vector(parts))).alias("_s"),
                                           F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    g = g.select(*by, "lo", "hi", "_mx", "_my", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(reps - 1)),
                                                            lambda i: F.slice("_s", i * 5 + 1, 5))).alias("_rep", "_v"))
    sw, sx, sy, sxx, sxy = [F.col("_v")[i] for i in range(5)]
    slope = F.try_divide(sxy - sx * sy / sw, sxx - sx * sx / sw)
    g = g.withColumn("slope", slope).withColumn("icpt", (sy - F.col("slope") * sx) / sw)
    g = g.withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    g = g.withColumn("gx", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("gi") / float(grid - 1))
    g = g.withColumn("gy", F.col("_my") + F.col("icpt") + F.col("slope") * (F.col("gx") - F.col("_mx")))
    a = (1.0 - level) / 2.0
    return g.groupBy(*by, "gi", "gx").agg(F.percentile("gy", a).alias("band_low"),
                                          F.percentile("gy", 1.0 - a).alias("band_high"))


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], buckets: int = 64,
                    names: Sequence[str] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation (``percentile`` / pandas /
    NumPy default) without holding a group's values in one buffer.

    Rows are counted by distinct value first.  Only a group with more than
    ``chunk_rows`` of these is cut into chunks, at approximate quantile
    boundaries; chunk counts give each chunk's offset in the sorted order,
    and in the chunks that hold a wanted order statistic the values' counts
    are cumulated (no row-level sort).  Output: ``by, n, <names>``.
    """
    part = list(by)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    v = F.col(col).cast("double")
    valid = df.select(*part, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    held = valid.groupBy(*part, "_v").agg(F.count(F.lit(1)).alias("_t"))
    sizes = held.groupBy(*part).agg(F.sum("_t").alias("_n"), F.count(F.lit(1)).alias("_values"))
    if part:
        many = held.join(sizes.where(F.col("_values") > chunk_rows).select(*part), part, "left_semi")
        r = held.join(sizes, part).join(_chunk_bounds(many, part, F.col("_v"), buckets), part, "left")
    else:
        r = _attach(_attach(held, sizes), _chunk_bounds(held, part, F.col("_v"), buckets))
    pid = F.when(F.col("_values") > chunk_rows, _chunk_of(F.col("_v"), buckets, chunk_rows)).otherwise(F.lit(0))
    r = r.withColumn("_pid", pid).drop("_b", "_q_lo", "_q_hi", "_q_n", "_values")
    counts = r.groupBy(*part, "_pid", "_n").agg(F.sum("_t").alias("_c"))
    wo = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(1))).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_c").over(wo), F.lit(0)))
    # wanted 0-based positions: floor and ceil of p * (n - 1)
    pos = F.array(*[F.struct(F.lit(i).alias("qi"), (F.lit(p) * (F.col("_n") - 1)).alias("h")) for i, p in enumerate(probs)])
    want = counts.select(*part, "_pid", "_n", "_off", "_c", F.explode(pos).alias("_w"))
    want = want.select(*part, "_pid", "_n", "_off", "_c", "_w.qi", "_w.h",
                       F.explode(F.array(F.floor("_w.h"), F.ceil("_w.h"))).alias("_k"))
    want = want.where((F.col("_k") >= F.col("_off")) & (F.col("_k") < F.col("_off") + F.col("_c")))
    need = want.select(*part, "_pid").distinct()
    # order statistics from counts of distinct values (no row-level sort):
    # value v covers positions [off + cum - t, off + cum) of the sorted group
    vals = r.join(need, [*part, "_pid"], "left_semi").select(*part, "_pid", "_v", "_t")
    wc = Window.partitionBy(*part, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    vals = vals.withColumn("_cum", F.sum("_t").over(wc))
    hit = want.join(vals, [*part, "_pid"]).where(
        (F.col("_k") >= F.col("_off") + F.col("_cum") - F.col("_t")) & (F.col("_k") < F.col("_off") + F.col("_cum")))
    g = hit.groupBy(*part, "_n", "qi", "h").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                                 F.min("_k").alias("_klo"))
    frac = F.col("h") - F.floor("h")
    g = g.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac)
    wide = g.groupBy(*part, F.col("_n").alias("n")).pivot("qi", list(range(len(probs)))).agg(F.first("_q"))
    return wide.select(*part, "n", *[F.col(str(i)).alias(nm) for i, nm in enumerate(names)])


def _attach(df, one_row):
    from vantage.operators.relational import attach
    return attach(df, one_row)


def pearson_many(df: DataFrame, by: Sequence[str], pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """L2 for several (x, y, name) pairs in one aggregate: ``n, r_<name>, p_<name>``.

    ``n`` counts the rows of the group (rows with a NULL in a pair count
    for that pair only through ``covar_pop`` / ``stddev_pop``)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for x, y, nm in pairs:
        xv, yv = F.col(x).cast("double"), F.col(y).cast("double")
        aggs += [F.covar_pop(xv, yv).alias(f"_c_{nm}"), F.stddev_pop(xv).alias(f"_sx_{nm}"),
                 F.stddev_pop(yv).alias(f"_sy_{nm}")]
    g = df.groupBy(*by).agg(*aggs)
    out = [*by, "n"]
    for _, _, nm in pairs:
        sx, sy = F.col(f"_sx_{nm}"), F.col(f"_sy_{nm}")
        r = F.when((sx > 0) & (sy > 0), F.greatest(F.least(F.try_divide(F.col(f"_c_{nm}"), sx * sy), F.lit(1.0)),
                                                   F.lit(-1.0)))
        out.append(r.alias(f"r_{nm}"))
    g = g.select(*out)
    for _, _, nm in pairs:
        r = F.col(f"r_{nm}")
        t = r * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1.0 - r * r))
        g = g.withColumn(f"_t_{nm}", F.when((F.abs(r) < 1.0) & (F.col("n") >= 3), t))
        p = (F.when(r.isNull() | (F.col("n") < 3), _null_d()).when(F.abs(r) >= 1.0, F.lit(0.0))
             .otherwise(dist.col_t_sf2(f"_t_{nm}", "n - 2")))
        g = g.withColumn(f"p_{nm}", p).drop(f"_t_{nm}")
    return g
