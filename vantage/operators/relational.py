"""C*, D*, E*, F*, G*, H*: filters, joins, aggregates, windows, sorts, sets.

All grouped by any key list ``by``.  Joins are plain equi-joins: the
optimizer picks broadcast (AQE, on the measured size) or sort-merge, and
AQE splits skewed partitions.  Windows are only used partitioned by a
key and on aggregated rows, or with a limit (``WindowGroupLimit`` cuts
each partition to the top rows *before* the shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# ---------------------------------------------------------------- C: filters

def quality_filter(df: DataFrame, metric: str, threshold: float, strict: bool = True) -> DataFrame:
    """``metric > threshold`` (strict) or ``>=``."""
    c = F.col(metric)
    return df.where(c > threshold if strict else c >= threshold)


def cutoff_filter(df: DataFrame, svr_min: float = 20, cat_max: int = 25,
                  svr: str = "subject_variable_ratio", cats: str = "num_categorical_vars") -> DataFrame:
    """``svr >= svr_min and categories <= cat_max``."""
    return df.where((F.col(svr) >= svr_min) & (F.col(cats) <= cat_max))


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """C4: drop rows with NULL (or NaN) in ``subset`` (all columns by default)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def min_group_size(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Keep groups with at least ``n`` rows (counted once, semi-joined back)."""
    keep = df.groupBy(*by).count().where(F.col("count") >= n).select(*by)
    return df.join(keep, list(by), "left_semi")


def head_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    ``row_number() <= n`` becomes a ``WindowGroupLimit``: each map task keeps
    at most ``n`` rows per group before the shuffle, so a hot group ships
    ``n`` rows per partition, not all of them.
    """
    w = Window.partitionBy(*by).orderBy(*[F.col(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def segment_flag(df: DataFrame, flag: Column, name: str = "segment") -> DataFrame:
    """Keep the split as a grouping key instead of two filtered copies."""
    return df.withColumn(name, flag)


def min_classes(df: DataFrame, by: Sequence[str], label: str, n: int = 2) -> DataFrame:
    """Keep groups whose label has at least ``n`` distinct classes."""
    keep = df.groupBy(*by).agg(F.countDistinct(label).alias("_k")).where(F.col("_k") >= n).select(*by)
    return df.join(keep, list(by), "left_semi")


# ---------------------------------------------------------------- D: joins

def merge_results(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes=("_x", "_y"),
                  null_safe: bool = False) -> DataFrame:
    """Inner equi-join; clashing non-key columns get suffixes.

    ``null_safe`` matches NULL keys to each other (pandas ``merge``)."""
    on = list(on)
    clash = (set(left.columns) & set(right.columns)) - set(on)
    lf = left.select(*[F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in left.columns])
    rt = right.select(*[F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in right.columns])
    if not null_safe:
        return lf.join(rt, on, "inner")
    rt2 = rt.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in rt.columns])
    cond = None
    for k in on:
        e = lf[k].eqNullSafe(rt2[f"_r_{k}"])
        cond = e if cond is None else cond & e
    return lf.join(rt2, cond, "inner").drop(*[f"_r_{k}" for k in on])


def merge_with_metadata(pairs: DataFrame, meta: DataFrame, on: str = "dataset", dedupe: bool = False) -> DataFrame:
    """Pair table + metadata.  With ``dedupe`` the metadata is first cut to
    one row per key (the reference fans out instead)."""
    if dedupe:
        # the least whole row of each key: never values of different rows
        rest = F.struct(*[F.col(c) for c in meta.columns if c != on])
        meta = meta.groupBy(on).agg(F.min(rest).alias("_row")).select(on, "_row.*")
    return pairs.join(meta, on, "inner")


def semi_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep rows whose key exists in ``keys``."""
    return df.join(keys.select(*on), list(on), "left_semi")


def pending(work: DataFrame, done: DataFrame, on: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Rows of ``work`` whose key has not been processed yet."""
    return work.join(done.select(*on), list(on), "left_anti")


# ---------------------------------------------------------------- E: aggregates

def best_score(df: DataFrame, by: Sequence[str], metric: str, out: str | None = None) -> DataFrame:
    """E5: max per group, NaN treated as missing (Spark's max ranks NaN highest)."""
    v = F.col(metric)
    return df.groupBy(*by).agg(F.max(F.when(~F.isnan(v), v)).alias(out or metric))


def best_row(df: DataFrame, by: Sequence[str], metric: str, tiebreak: Sequence[str]) -> DataFrame:
    """The whole row with the highest ``metric`` per group; ties go to the
    smallest ``tiebreak`` values (deterministic)."""
    cols = [c for c in df.columns if c not in by]
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc_nulls_last(), *[F.col(t).asc() for t in tiebreak])
    return (df.where(F.col(metric).isNotNull()).withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") == 1).select(*by, *cols))


def n_distinct(df: DataFrame, by: Sequence[str], cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct rows over ``cols`` per group."""
    if approx:
        return df.groupBy(*by).agg(F.approx_count_distinct(F.struct(*cols)).alias("n_distinct"))
    return df.groupBy(*by).agg(F.countDistinct(*cols).alias("n_distinct"))


def class_balance(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Number of classes and the smallest / largest class size per group."""
    c = df.groupBy(*by, label).count()
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("n_classes"), F.min("count").alias("min_class"),
                              F.max("count").alias("max_class"))


def win_rate(df: DataFrame, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """Percent of rows where ``flag`` is true."""
    return df.groupBy(*by).agg((F.avg(F.col(flag).cast("double")) * 100.0).alias("win_rate"),
                               F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, by: Sequence[str], metric: str, outliers: bool = False) -> DataFrame:
    """Quartiles (linear interpolation), whiskers at the most extreme
    points within 1.5 IQR, and the number of points outside them.

    Exact quartiles without a per-group value buffer (``exact_quantiles``);
    the whisker pass joins the per-group quartiles back to the rows.
    """
    from vantage.operators.stats import exact_quantiles

    v = F.col(metric)
    q = exact_quantiles(df, by, metric, [0.25, 0.5, 0.75], names=["q1", "median", "q3"])
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    j = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v")).join(q, list(by))
    inside = (F.col("_v") >= lo) & (F.col("_v") <= hi)
    w = j.groupBy(*by).agg(F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
                           F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
                           F.count(F.when(~inside, 1)).alias("n_outliers"))
    out = q.join(w, list(by))
    return out if outliers else out.drop("n_outliers")


def extent(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Min, max and count (axes, grids, titles)."""
    return df.groupBy(*by).agg(F.min(col).alias("min"), F.max(col).alias("max"), F.count(col).alias("n"))


def cell_profile(samples: DataFrame, cells: Sequence[str] = ("cat1", "cat2"),
                 metrics: Sequence[str] = ("x1", "x2", "x3")) -> DataFrame:
    """Per (dataset, cell): row count and metric means."""
    return samples.groupBy("dataset", *cells).agg(F.count(F.lit(1)).alias("n"),
                                                  *[F.avg(m).alias(f"{m}_mean") for m in metrics])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "variable",
         value: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(list(ids), list(values), var, value)


def keys(df: DataFrame, col: str) -> DataFrame:
    """Distinct keys of a column."""
    return df.select(col).distinct()


# ---------------------------------------------------------------- F: windows

def second_difference(df: DataFrame, by: Sequence[str], order: str, value: str, out: str = "d2") -> DataFrame:
    """v[k+2] - 2 v[k+1] + v[k] within each group (NULL at the tail)."""
    w = Window.partitionBy(*by).orderBy(order)
    v = F.col(value)
    return df.withColumn(out, F.lead(v, 2).over(w) - 2 * F.lead(v, 1).over(w) + v)


def leaderboard(df: DataFrame, metric: str, by: Sequence[str] = (), out: str = "position") -> DataFrame:
    """rank by ``metric`` descending (ties share the position).  Meant for
    aggregated rows (one per model)."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc()) if by else Window.orderBy(F.col(metric).desc())
    return df.withColumn(out, F.rank().over(w).cast("bigint"))


# ---------------------------------------------------------------- G: sort / top-k

def top_k(df: DataFrame, metric: str, k: int, by: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> DataFrame:
    """The ``k`` highest rows (per group if ``by``); deterministic ties."""
    order = [F.col(metric).desc_nulls_last(), *[F.col(t).asc() for t in tiebreak]]
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    # filter on the bare row_number so Catalyst infers a WindowGroupLimit
    top = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


def preview(df: DataFrame, n_datasets: int = 3, key: str = "dataset") -> DataFrame:
    """Rows of the first ``n_datasets`` datasets in sorted key order."""
    first = df.select(key).distinct().orderBy(key).limit(n_datasets)
    return df.join(first, key, "left_semi")


# ---------------------------------------------------------------- H: sets

def union_results(*dfs: DataFrame) -> DataFrame:
    """H1: union by name, missing columns as NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def append_dedupe(old: DataFrame, new: DataFrame) -> DataFrame:
    """H2: append new results to old and drop exact duplicates."""
    return old.unionByName(new, allowMissingColumns=True).dropDuplicates()


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table (global statistics, fitted
    parameters) to every row: an equi-join on a constant key.  The broadcast
    side is one row by contract (an aggregate without keys), so ``df`` is
    never shuffled on the constant."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def dataset_metadata(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str],
                     extra_levels: str | None = None) -> DataFrame:
    """Per dataset ``n_rows, n_cols, num_categorical_vars,
    subject_variable_ratio`` (SVR = rows / columns, a documented choice:
    the reference names the ratio but never writes its producer).

    ``extra_levels`` optionally adds the distinct count of another column
    (one per 25 levels) to the categorical count."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if extra_levels:
        aggs.append(F.countDistinct(extra_levels).alias("_lv"))
    g = df.groupBy(key).agg(*aggs)
    ncat = F.lit(len(categorical))
    if extra_levels:
        ncat = ncat + F.floor(F.col("_lv") / 25)
    ncols = F.lit(len(numeric)) + ncat
    return g.select(key, "n_rows", ncols.cast("int").alias("n_cols"), ncat.cast("int").alias("num_categorical_vars"),
                    (F.col("n_rows") / ncols).alias("subject_variable_ratio"))
