"""J*: feature preparation, grouped by any key list ``by``.

Everything is expressed as aggregates joined back or as window-free
column expressions, so a split or an imputation never moves a whole
group through one task except for exact medians (a percentile, which is
a sort of the group's values for that one column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.operators.neighbors import knn_within

#: Rows of a stratum whose hashes fall into one part of their range, about.
PART_ROWS = 1024


def split_flag(key: Column, test_share: float = 0.3, seed: int = 42) -> Column:
    """Deterministic train/test assignment from the row key.

    ``md5(key|seed)``'s first 32 bits, compared as fixed-width hex text
    with ``test_share * 2^32``: stable under any repartitioning, no
    shuffle, and reproducible in any SQL engine with ``md5``.
    """
    threshold = format(int(test_share * 2 ** 32), "08x")
    return F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 8) < F.lit(threshold)


def split(df: DataFrame, key: str, test_share: float = 0.3, seed: int = 42, out: str = "is_test") -> DataFrame:
    return df.withColumn(out, split_flag(F.col(key), test_share, seed))


def stratified_split(df: DataFrame, by: Sequence[str], label: str, key: str,
                     test_share: float = 0.3, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Per (by, label) stratum, the ``ceil(test_share * n)`` rows with the
    smallest hash go to test; strata of one row stay in training.

    Which rows these are follows from one hash value per stratum, the largest
    whose average rank is within the share: hashes are uniform, so the counts
    of equal-width parts of their range say in which part it lies, and only
    that part's values are ranked.  No row is sorted, and a stratum holding a
    third of the data is never in one task.
    """
    strata = [*by, label]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 13), 16, 10)
    hashed = df.withColumn("_h", h.cast("double"))
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    part = F.floor(F.col("_h") / 2.0 ** 52 * F.ceil(F.col("_n") / PART_ROWS)).cast("bigint")
    last = F.ceil(F.col("_n") * test_share)
    r = hashed.select(*strata, "_h").join(sizes, strata).withColumn("_part", part)
    below = Window.partitionBy(*strata).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = r.groupBy(*strata, "_n", "_part").agg(F.count(F.lit(1)).alias("_c")).withColumn("_off", F.coalesce(F.sum("_c").over(below), F.lit(0)))
    edge = parts.where((F.col("_off") < last) & (last <= F.col("_off") + F.col("_c"))).select(*strata, "_part", "_off")
    ties = r.join(edge, [*strata, "_part"]).groupBy(*strata, "_n", "_part", "_off", "_h").agg(F.count(F.lit(1)).alias("_tv"))
    upto = Window.partitionBy(*strata, "_part").orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.col("_off") + F.sum("_tv").over(upto) - (F.col("_tv") - 1) / 2.0
    bound = ties.withColumn("_rn", rank).groupBy(*strata, F.col("_part").alias("_edge")).agg(F.max(F.when(F.col("_rn") <= last, F.col("_h"))).alias("_max"))
    within = F.coalesce((part < F.col("_edge")) | (F.col("_h") <= F.col("_max")), part < F.col("_edge"), F.lit(False))
    return (hashed.join(sizes.join(bound, strata, "left"), strata)
                  .withColumn(out, (F.col("_n") >= 2) & within)
                  .drop("_n", "_h", "_edge", "_max"))


def impute(df: DataFrame, by: Sequence[str], cols: Sequence[str], strategy: str = "mean",
           fit_on: Column | None = None) -> DataFrame:
    """Fill NULL/NaN numeric values with the group mean or exact median.

    ``fit_on`` restricts the rows the statistic is computed from (e.g. the
    training rows).  The per-group statistics are one row per group and
    are joined back on ``by``.
    """
    src = df if fit_on is None else df.filter(fit_on)
    clean = {c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in cols}
    if strategy == "mean":
        stats = src.groupBy(*by).agg(*[F.avg(clean[c]).alias(f"_fill_{c}") for c in cols])
    elif strategy == "median":
        from vantage.operators.stats import exact_quantiles
        # one pass over (column, value): many columns take no more jobs than one
        tall = src.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("_col"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)])).alias("_t"))
        q = exact_quantiles(tall.select(*by, "_t.*"), [*by, "_col"], "_v", [0.5], names=["_q"])
        stats = q.groupBy(*by).pivot("_col", list(range(len(cols)))).agg(F.first("_q"))
        stats = stats.select(*by, *[F.col(str(i)).alias(f"_fill_{c}") for i, c in enumerate(cols)])
    else:
        raise ValueError(strategy)
    out = df.join(stats, list(by), "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(clean[c], F.col(f"_fill_{c}")))
    return out.drop(*[f"_fill_{c}" for c in cols])


def impute_mode(df: DataFrame, by: Sequence[str], cols: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Fill NULL categories with the most frequent value, smallest on ties.

    Value counts are a partial aggregate per (group, value); the winner is
    picked on those counted rows, so no group's values meet in one buffer.
    """
    src = df if fit_on is None else df.filter(fit_on)
    stats = None
    for c in cols:
        cnt = src.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count(F.lit(1)).alias("_cnt"))
        w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(F.col("_cnt").desc(), F.col(c))
        m = cnt.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(*by, F.col(c).alias(f"_mode_{c}"))
        stats = m if stats is None else stats.join(m, list(by), "full")
    out = df.join(stats, list(by), "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_mode_{c}")))
    return out.drop(*[f"_mode_{c}" for c in cols])


def indicator(col: str, level: str) -> Column:
    """J3 (one level): 1.0 when ``col`` equals ``level``; NULL/unseen -> 0."""
    return F.when(F.col(col) == F.lit(level), F.lit(1.0)).otherwise(F.lit(0.0))


def one_hot(df: DataFrame, col: str, levels: Sequence[str], drop_first: bool = False, prefix: str | None = None) -> DataFrame:
    """One indicator column per level (``<col>_<level>``); unseen and NULL
    map to all zeros.  ``drop_first`` drops the first level (the
    reference's drop-if-binary form)."""
    prefix = prefix or col
    use = list(levels)[1:] if drop_first else list(levels)
    return df.select("*", *[indicator(col, lv).alias(f"{prefix}_{lv}") for lv in use])


def standardize(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std per group (the scikit-learn scaler)."""
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols],
                                *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    out = df.join(stats, list(by), "left") if by else _attach(df, stats)
    for c in cols:
        sd = F.col(f"_sd_{c}")
        out = out.withColumn(c, F.when(sd > 0, (F.col(c) - F.col(f"_mu_{c}")) / sd).otherwise(F.lit(0.0)))
    return out.drop(*[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])


def feature_matrix(df: DataFrame, by: Sequence[str], numeric: Sequence[str], categorical: dict,
                   fit_on: Column | None = None, out: str = "features") -> DataFrame:
    """Numeric branch (median imputation) and categorical branch (mode
    imputation + one-hot) assembled into one ``ARRAY<DOUBLE>`` column;
    ``<out>_names`` is not stored per row -- the names are
    ``numeric + [f"{c}_{level}"]`` in this order."""
    x = impute(df, by, numeric, "median", fit_on)
    x = impute_mode(x, by, list(categorical), fit_on)
    cols = [F.col(c).cast("double") for c in numeric]
    for c, levels in categorical.items():
        cols += [indicator(c, lv) for lv in levels]
    return x.withColumn(out, F.array(*cols))


def feature_names(numeric: Sequence[str], categorical: dict) -> list[str]:
    return list(numeric) + [f"{c}_{lv}" for c, levels in categorical.items() for lv in levels]


def smote(df: DataFrame, by: Sequence[str], id_col: str, vec: str, label: str, k: int = 5,
          seed: int = 42) -> DataFrame:
    """SMOTE -- every class of a group is oversampled to the majority size.

    Neighbours are the exact ``min(k, n_class - 1)`` nearest members of the
    same class (``knn_within``).  Synthetic rows go round-robin over the
    class members (in hash order); each picks one neighbour and a gap
    in [0, 1) from a hash of (id, copy, seed):  x + gap * (neighbour - x).
    Output: ``by, label, id, vec, synthetic`` (originals + new rows).
    """
    from vantage.operators.stats import avg_rank
    from vantage.session import checkpoint_dir

    by = list(by)
    checkpoint_dir(df.sparkSession)
    base = df.select(*by, label, id_col, F.col(vec).cast("array<double>").alias(vec))
    sizes = base.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_nc"))
    wmax = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    sizes = sizes.withColumn("_need", F.max("_nc").over(wmax) - F.col("_nc"))
    nn = knn_within(base, [*by, label], id_col, vec, k)
    nbrs = nn.groupBy(*by, label, id_col).agg(F.array_sort(F.collect_list(F.struct("d", "nbr", "nbr_vec"))).alias("_nb"))
    # members by hash order: the exact distributed rank of a 52-bit hash, so
    # a large class is never sorted in one task
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 13), 16, 10)
    m = base.join(sizes, [*by, label]).where(F.col("_need") > 0).withColumn("_h", h.cast("double"))
    m = avg_rank(m, [*by, label], "_h", "_rk", distributed=True).withColumn("_rk", F.col("_rk") - 1)
    copies = (F.floor(F.col("_need") / F.col("_nc")) + F.when(F.col("_rk") < F.col("_need") % F.col("_nc"), 1).otherwise(0))
    m = m.withColumn("_copies", copies.cast("int")).where(F.col("_copies") > 0)
    m = m.join(nbrs, [*by, label, id_col], "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    hh = F.xxhash64(F.col(id_col), F.col("_copy"), F.lit(seed))
    pick = (F.abs(hh) % F.size("_nb")).cast("int")
    gap = (F.abs(F.xxhash64(F.col(id_col), F.col("_copy"), F.lit(seed + 1))) % 1000003) / 1000003.0
    nv = F.coalesce(F.when(F.size("_nb") > 0, F.element_at("_nb", pick + 1)["nbr_vec"]), F.col(vec))  # a class of one repeats its row
    new = m.select(*by, label, F.concat_ws("#", F.col(id_col).cast("string"), F.col("_copy").cast("string")).alias(id_col),
                   F.zip_with(vec, nv, lambda a, b: a + gap * (b - a)).alias(vec), F.lit(True).alias("synthetic"))
    orig = base.select(*by, label, F.col(id_col).cast("string").alias(id_col), vec, F.lit(False).alias("synthetic"))
    return orig.unionByName(new)


def _attach(df, one_row):
    from vantage.operators.relational import attach
    return attach(df, one_row)
