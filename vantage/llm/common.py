"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from itertools import combinations
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.session import checkpoint_dir

#: Rows and bytes of one Arrow batch at most: a worker holds a batch and its result, whatever the row sizes.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, unless their PYTHONPATH has it."""
    root = Path(__file__).resolve().parents[2]
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in on_path or app in _SHIPPED:
        return
    _SHIPPED.add(app)
    name = Path(tempfile.mkdtemp(prefix="vantage-"), "vantage-package.zip")  # on the driver, which serves it while the session lasts
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.glob("vantage/**/*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(name))


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits so that long texts cannot fill a Python worker, and see that workers have the package."""
    ship(spark)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` does not have (compared without case)."""
    have, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name, k = f"__{base}", 0
        while name.lower() in have:
            k += 1
            name = f"__{base}{k}"
        have.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def never_sent(df: DataFrame) -> DataFrame:
    """``df``, a table of about a row per document or more, for a join: both sides are shuffled and sorted.

    Spark sizes a table by its packed file and sees no rows that an explode
    adds, so it would broadcast one that the driver's memory cannot hold.
    """
    return df.hint("merge")


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node of each component among ``n`` nodes joined by the links ``(i, j)``."""
    lab = np.arange(n)
    while len(i):
        a, b = lab[i], lab[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = lab[lab]
            if (nxt == lab).all():
                break
            lab = nxt
    return lab


def components(edges: DataFrame, small: int = 200_000) -> DataFrame:
    """Connected components: ``edges(a, b)`` bigint -> ``(node, comp)`` for every node of an edge.

    Randomised contraction: each round every node joins the neighbour (or
    itself) of least seeded hash, edges are rewritten to the chosen nodes and
    de-duplicated; a round removes an expected constant share of the nodes.
    Once at most ``small`` edges are left (16 bytes each), one task ends the
    job with a union-find: the same result, without more rounds.  Labels are
    opaque; equal labels mean connected.  Null ends and loops are ignored.
    """
    ship(edges.sparkSession)
    live = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while (left := live.count()) > small:
        k = len(maps)
        both = live.union(live.select("b", "a")).toDF("node", "other")
        key = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.alias("v"))
        rep = both.groupBy("node").agg(F.least(F.min(key(F.col("other"))), key(F.col("node")))["v"].alias("rep"))
        rep = materialise(rep, "reps")
        maps.append(rep)
        ra, rb = rep.toDF("a", "ra"), rep.toDF("b", "rb")
        live = live.join(never_sent(ra), "a").join(never_sent(rb), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        live = materialise(live, "edges")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(pdf[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        at = at.reshape(-1, 2)
        return pd.DataFrame({"node": ids, "comp": ids[roots(len(ids), at[:, 0], at[:, 1])]})

    last = None
    if left:
        last = live.groupBy(F.lit(0).alias("one")).applyInPandas(finish, "node bigint, comp bigint")
        last = materialise(last, "comps")
    if not maps:
        return last if last is not None else edges.sparkSession.createDataFrame([], "node bigint, comp bigint")
    for rep in reversed(maps):
        named = rep if last is None else rep.join(never_sent(last.toDF("rep", "comp")), "rep", "left")
        comp = F.col("rep") if last is None else F.coalesce("comp", "rep")
        last = materialise(named.select("node", comp.alias("comp")), "comps")
    return last


def ball(width: int, radius: int) -> list[int]:
    """XOR masks of ``width`` bits with at most ``radius`` bits set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
