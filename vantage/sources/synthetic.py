"""A4: the synthetic table source of the reference, as one Spark job.

``n_datasets`` tables of ``n_rows`` rows: x1, x2 ~ U(-10, 10), one of four
response equations per dataset plus N(0, 5) noise, random cat1 in {A, B}
and cat2 in {X, Y}, then x1 += 50 for B and x2 += 50 for Y -- *after* x3
is computed.  All datasets are rows of one DataFrame built from
``spark.range``; randomness comes from seeded ``rand``/``randn`` and hashes,
so the output is the same for the same seed and partitioning.  (NumPy's
generator streams are not reproduced: the values differ from the
reference's files, the distributions do not.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.sources.testdata import EQUATIONS, response


def synthetic_samples(spark: SparkSession, n_datasets: int = 100, n_rows: int = 500, seed: int = 0,
                      partitions: int | None = None) -> DataFrame:
    """``dataset, seed, equation, row_id, x1, x2, x3, cat1, cat2``."""
    n = n_datasets * n_rows
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(0, n)
    ds = (F.col("id") / n_rows).cast("bigint")
    eq_idx = (F.abs(F.xxhash64(ds, F.lit(seed))) % len(EQUATIONS)).cast("int")
    eq = F.element_at(F.array(*[F.lit(e) for e in EQUATIONS]), eq_idx + 1)
    df = base.select(ds.alias("ds"), (F.col("id") % n_rows).alias("row_id"), eq.alias("equation"),
                     (F.rand(seed) * 20.0 - 10.0).alias("x1r"), (F.rand(seed + 1) * 20.0 - 10.0).alias("x2r"),
                     (F.randn(seed + 2) * 5.0).alias("noise"),
                     F.when(F.rand(seed + 3) < 0.5, F.lit("A")).otherwise(F.lit("B")).alias("cat1"),
                     F.when(F.rand(seed + 4) < 0.5, F.lit("X")).otherwise(F.lit("Y")).alias("cat2"))
    return df.select(
        F.concat(F.lit("data_"), F.col("ds").cast("string"), F.lit("_"), F.col("equation")).alias("dataset"),
        F.col("ds").alias("seed"), "equation", "row_id",
        (F.col("x1r") + F.when(F.col("cat1") == "B", 50.0).otherwise(0.0)).alias("x1"),
        (F.col("x2r") + F.when(F.col("cat2") == "Y", 50.0).otherwise(0.0)).alias("x2"),
        response(F.col("equation"), F.col("x1r"), F.col("x2r"), F.col("noise")).alias("x3"),
        "cat1", "cat2")
