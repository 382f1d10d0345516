from pyspark.sql import functions as F

from vantage.operators import stats as ST
from vantage.sources import testdata as V
from vantage.streaming.incremental import run_incremental


def test_incremental_resume(spark, sf_small, tmp_path):
    s = V.scores(spark, sf_small)
    src = str(tmp_path / "in")
    res = str(tmp_path / "res")
    ck = str(tmp_path / "ck")
    s.where(F.col("model") != "click").write.parquet(src + "/part1")

    def compute(df):
        return ST.summarize(df, ["dataset", "model"], ["auc"], ["mean", "count"])

    run_incremental(spark, src + "/*", s.schema, res, compute, checkpoint_location=ck).awaitTermination()
    first = spark.read.parquet(res).count()
    # new input: a repeat of old keys plus the missing model
    s.write.parquet(src + "/part2")
    run_incremental(spark, src + "/*", s.schema, res, compute, checkpoint_location=ck).awaitTermination()
    out = spark.read.parquet(res)
    expected = s.select("dataset", "model").distinct().count()
    assert out.count() == expected > first
    assert out.select("dataset", "model").distinct().count() == expected


def test_partials_keep_late_rows(spark, sf_small, tmp_path):
    from vantage.streaming.incremental import merged

    s = V.scores(spark, sf_small).select("dataset", "model", "auc")
    src, res, ck = (str(tmp_path / x) for x in ("in", "res", "ck"))
    part = lambda df: df.groupBy("dataset", "model").agg(F.count("auc").alias("n"), F.sum("auc").alias("t"))
    for k in range(2):
        s.where(F.pmod(F.hash("auc"), F.lit(2)) == k).write.parquet(f"{src}/part{k}")
        run_incremental(spark, src + "/*", s.schema, res, part, ck, partials=True).awaitTermination()
    out = merged(spark, res, lambda p: p.groupBy("dataset", "model").agg(F.sum("n").alias("n"), (F.sum("t") / F.sum("n")).alias("m")))
    got = {(r.dataset, r.model): (r.n, round(r.m, 9)) for r in out.collect()}
    want = s.groupBy("dataset", "model").agg(F.count("auc").alias("n"), F.avg("auc").alias("m")).collect()
    assert got == {(r.dataset, r.model): (r.n, round(r.m, 9)) for r in want}
