"""Views over the bundled Parquet tables that stand in for the reference's data.

The reference works on 100 generated tables of 500 rows, their text
embeddings and the result tables of its model runs.  Here each of those is
a *view* derived by Spark from the given Parquet tables, so every query
grows with its input:

* ``samples``  (V1, from ``lineitem``): one dataset per supplier, the four
  response equations of the generator, categories from the line flags.
* ``emb_long`` / ``emb_raw`` (V2, from ``embeddings``): dataset = label,
  four "models" = the four 16-wide slices of the vector, raw features =
  the first three coordinates.
* ``scores``   (V3, from ``events``): similarity scores per
  (dataset, model), one row per event.
* ``dataset_meta`` (V5): table metadata per dataset of ``samples``.
* ``docs``     (V6): ``documents`` joined to ``labels``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The four response equations of the generator, in the order
# used to assign them to datasets (index = supplier key mod 4).
EQUATIONS = ["linear", "quadratic", "cubic", "exponential"]

# Split parameters used by the views (test share 0.3, seed 42).
TEST_SHARE = 0.3
SPLIT_SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def equation_of(key: Column) -> Column:
    idx = (key % 4).cast("int")
    out = F.when(idx == 0, F.lit(EQUATIONS[0]))
    for i, eq in enumerate(EQUATIONS[1:], start=1):
        out = out.when(idx == i, F.lit(eq))
    return out


def response(eq: Column, x1: Column, x2: Column, noise: Column) -> Column:
    """x3 by the four equations (computed before the category shifts)."""
    return (F.when(eq == "linear", 3 * x1 + 2 * x2 + noise)
            .when(eq == "quadratic", x1 * x1 - 2 * x2 + noise)
            .when(eq == "cubic", x1 * x1 * x1 - x2 * x2 + noise)
            .otherwise(F.exp(0.1 * x1) - F.exp(0.1 * x2) + noise))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: long sample table ``dataset, equation, ok, ln, pk, row_key, x1, x2, x3, cat1, cat2``.

    ``(ok, ln, pk)`` orders rows inside a dataset (the file order of the
    reference); ``row_key`` is the text key hashed by the split.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    eq = equation_of(F.col("l_suppkey"))
    x1 = (F.col("l_quantity") - 25.5) / 2.45
    x2 = (F.col("l_discount") - 0.05) * 200.0
    noise = (F.col("l_tax") - 0.04) * 250.0
    cat1 = F.when(F.col("l_linestatus") == "O", F.lit("B")).otherwise(F.lit("A"))
    cat2 = F.when(F.col("l_returnflag") == "R", F.lit("Y")).otherwise(F.lit("X"))
    base = li.select(
        F.concat(F.lit("data_"), F.col("l_suppkey").cast("string"), F.lit("_"), eq).alias("dataset"),
        eq.alias("equation"),
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"),
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        x1.alias("x1r"), x2.alias("x2r"), noise.alias("noise"), cat1.alias("cat1"), cat2.alias("cat2"),
    )
    return base.select(
        "dataset", "equation", "ok", "ln", "pk", "row_key",
        (F.col("x1r") + F.when(F.col("cat1") == "B", 50.0).otherwise(0.0)).alias("x1"),
        (F.col("x2r") + F.when(F.col("cat2") == "Y", 50.0).otherwise(0.0)).alias("x2"),
        response(F.col("equation"), F.col("x1r"), F.col("x2r"), F.col("noise")).alias("x3"),
        "cat1", "cat2",
    )


# The four "models" are the four 16-wide slices of the vector.
EMB_MODELS = ["m0", "m1", "m2", "m3"]
EMB_WIDTH = 16


def emb_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: ``dataset, model, row_id, embedding ARRAY<DOUBLE>``."""
    e = table(spark, sf_dir, "embeddings")
    slices = F.array(*[
        F.struct(F.lit(m).alias("model"),
                 F.slice("embedding", i * EMB_WIDTH + 1, EMB_WIDTH).cast("array<double>").alias("v"))
        for i, m in enumerate(EMB_MODELS)])
    return (e.select(F.concat(F.lit("emb_"), F.col("label").cast("string")).alias("dataset"),
                     F.col("vec_id").alias("row_id"), F.explode(slices).alias("s"))
            .select("dataset", F.col("s.model").alias("model"), "row_id", F.col("s.v").alias("embedding")))


def emb_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 raw side: ``dataset, row_id, x1, x2, x3`` = first three coordinates."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("emb_"), F.col("label").cast("string")).alias("dataset"),
                    F.col("vec_id").alias("row_id"),
                    *[F.col("embedding")[i].cast("double").alias(f"x{i + 1}") for i in range(3)])


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: ``dataset, model, distance_correlation, cosine_similarity, auc, event_id``."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select(
        F.concat(F.lit("data_"), F.col("user_id").cast("string"), F.lit("_"),
                 equation_of(F.col("user_id"))).alias("dataset"),
        F.col("event_type").alias("model"),
        (F.col("value") / 500.0).alias("distance_correlation"),
        (k / 100.0).alias("cosine_similarity"),
        (0.5 + k / 200.0).alias("auc"),
        "event_id",
    )


def dataset_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dataset, n_rows, n_cols, num_categorical_vars, subject_variable_ratio``.

    The generated tables all have 3 numeric + 2 categorical columns; to
    give the metadata variation we count the distinct parts of each
    supplier as extra categorical levels (one per 25 parts).
    """
    from vantage.operators.relational import dataset_metadata

    return dataset_metadata(samples(spark, sf_dir), "dataset", ["x1", "x2", "x3"], ["cat1", "cat2"],
                            extra_levels="pk")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: labelled documents ``doc_id, text, lang, source, n_chars, quality, toxic``."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "inner")
