"""Scans, name parsing, sinks and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The clinical table's columns (13 attributes + outcome).
CLINICAL_SCHEMA = T.StructType([
    *[T.StructField(c, T.IntegerType()) for c in
      ["age", "sex", "cp", "trestbps", "chol", "fbs", "restecg", "thalach", "exang"]],
    T.StructField("oldpeak", T.DoubleType()),
    *[T.StructField(c, T.IntegerType()) for c in ["slope", "ca", "thal", "num"]],
])

# The sample-table schema written by the generator.
SAMPLE_SCHEMA = T.StructType([T.StructField("x1", T.DoubleType()), T.StructField("x2", T.DoubleType()),
                              T.StructField("x3", T.DoubleType()), T.StructField("cat1", T.StringType()),
                              T.StructField("cat2", T.StringType())])


def file_stem(col: Column) -> Column:
    """``/a/b/data_3_cubic.csv`` -> ``data_3_cubic``."""
    return F.regexp_extract(col, r"([^/]+?)(\.[^./]*)?$", 1)


def scan_keyed(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv",
               schema: T.StructType | None = None, key: str = "source") -> DataFrame:
    """A1: scan a directory (or glob) of files; each row gets its file stem.

    CSVs are read with a header and an explicit schema when one is given
    (schema inference costs a pass over the data); the stem comes from the
    hidden ``_metadata.file_name`` column, so no per-file loop runs on the
    driver.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("nullValue", "NA")
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    elif schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path if isinstance(path, str) else list(path))
    return df.select(file_stem(F.col("_metadata.file_name")).alias(key), *df.columns)


def parse_artifact_name(col: Column) -> list[Column]:
    """A2: ``data_{seed}_{equation}`` -> ``seed`` (BIGINT) and ``equation``."""
    return [F.regexp_extract(col, r"^data_([0-9]+)_", 1).try_cast("bigint").alias("seed"),
            F.element_at(F.split(col, "_"), -1).alias("equation")]


def parse_embedding_name(col: Column) -> list[Column]:
    """A2: ``embeddings_{model}_{dataset}`` -> ``model``, ``dataset``."""
    return [F.regexp_extract(col, r"^embeddings_([^_]+)_", 1).alias("model"),
            F.regexp_extract(col, r"^embeddings_[^_]+_(.+)$", 1).alias("dataset")]


def scan_embeddings(spark: SparkSession, path: str, nested: bool = False, fmt: str = "parquet", rows_per_partition: int = 100_000) -> DataFrame:
    """A3: embeddings ``dataset, model, row_id, embedding`` as doubles.

    From Parquet with these columns (``nested``: ARRAY<ARRAY<FLOAT>> rows are
    flattened), or with ``fmt="npy"`` from array files named
    ``embeddings_{model}_{dataset}.npy``, split by rows.
    """
    if fmt == "npy":
        from vantage.sources import npy

        npy.register(spark)
        df = spark.read.format("npy").option("rowsPerPartition", rows_per_partition).load(path)
        model, dataset = parse_embedding_name(F.regexp_replace("file", r"\.npy$", ""))
        return df.select(dataset, model, "row_id", "embedding")
    df = spark.read.parquet(path)
    e = F.flatten("embedding") if nested else F.col("embedding")
    return df.withColumn("embedding", e.cast("array<double>"))


def scan_clinical(spark: SparkSession, path: str) -> DataFrame:
    """A5: the 14-column clinical table ('?', 'NA' and blanks read as missing, numbers as their column's type)."""
    text = spark.read.option("header", True).csv(path, schema=", ".join(f"`{f.name}` string" for f in CLINICAL_SCHEMA))
    # whole numbers may be written 1.0; what is no number is missing too
    return text.select(*[F.when(~F.trim(f.name).isin("?", "NA", ""), F.trim(f.name)).try_cast("double").try_cast(f.dataType).alias(f.name) for f in CLINICAL_SCHEMA])


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                 mode: str = "overwrite") -> None:
    """Write a result table (CSV with a header, no index column).

    Per-file outputs of the reference become ``partitionBy`` directories.
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "input") -> DataFrame:
    """Stop with a message before building a plan on a wrong input."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required column(s): {', '.join(missing)}")
    return df


def events_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text column with numbers and 'NA' (B2's input): the ``k`` field of
    the events' JSON, 'NA' for error events."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = F.when(F.col("event_type") == "error", F.lit("NA")).otherwise(F.get_json_object("props", "$.k"))
    return ev.select("event_type", raw.alias("raw"))
