import pytest
from pyspark.sql import functions as F

from vantage.sources import files as A
from vantage.sources import testdata as V


def test_scan_keyed_csv_roundtrip(spark, sf_small, tmp_path):
    s = V.samples(spark, sf_small).select("dataset", "x1", "x2", "x3", "cat1", "cat2")
    out = str(tmp_path / "out")
    A.write_result(s, out, fmt="csv", partition_by=["dataset"])
    back = A.scan_keyed(spark, out + "/*/*.csv", fmt="csv", schema=A.SAMPLE_SCHEMA)
    assert back.count() == s.count()
    assert back.select("source").distinct().count() >= 1


def test_require_columns(spark, sf_small):
    s = V.samples(spark, sf_small)
    assert A.require_columns(s, ["x1", "x3"]) is s
    with pytest.raises(ValueError, match="missing"):
        A.require_columns(s, ["x9"])


def test_parse_names(spark):
    df = spark.createDataFrame([("data_12_cubic",), ("embeddings_bert_data_3_linear",)], "n string")
    r = df.select(*A.parse_artifact_name(F.col("n"))).first()
    assert r.seed == 12 and r.equation == "cubic"
    e = df.select(*A.parse_embedding_name(F.col("n"))).collect()[1]
    assert e.model == "bert" and e.dataset == "data_3_linear"


def test_samples_view_shape(spark, sf_small):
    s = V.samples(spark, sf_small)
    assert s.count() == spark.read.parquet(f"{sf_small}/lineitem.parquet").count()
    assert s.select("dataset").distinct().count() == spark.read.parquet(f"{sf_small}/supplier.parquet").count()


def test_synthetic_samples(spark):
    from vantage.sources.synthetic import synthetic_samples
    df = synthetic_samples(spark, n_datasets=20, n_rows=500, seed=7)
    assert df.count() == 10000
    assert df.select("dataset").distinct().count() == 20
    m = df.agg(F.avg(F.when(F.col("cat1") == "A", F.col("x1"))).alias("a"),
               F.avg(F.when(F.col("cat1") == "B", F.col("x1"))).alias("b"),
               F.min(F.when(F.col("cat1") == "A", F.col("x1"))).alias("lo"),
               F.max(F.when(F.col("cat1") == "A", F.col("x1"))).alias("hi")).first()
    assert abs(m.a) < 1.0 and abs(m.b - 50.0) < 1.0 and m.lo >= -10.0 and m.hi <= 10.0
    # x3 computed before the shift: for linear datasets x3 ~ 3 x1r + 2 x2r, so mean near 0
    lin = df.where(F.col("equation") == "linear").agg(F.avg("x3")).first()[0]
    assert lin is None or abs(lin) < 3.0
    assert df.collect() == synthetic_samples(spark, n_datasets=20, n_rows=500, seed=7).collect()


def test_dataset_metadata_generic(spark, sf_small):
    from vantage.operators.relational import dataset_metadata
    s = V.samples(spark, sf_small)
    g = dataset_metadata(s, "dataset", ["x1", "x2", "x3"], ["cat1", "cat2"])
    r = g.first()
    assert r.n_cols == 5 and r.num_categorical_vars == 2
    assert r.subject_variable_ratio == pytest.approx(r.n_rows / 5)
