"""Groups in pieces of bounded size: rows packed into chunks, and per-group models applied to them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.session import checkpoint_dir, ship_package

#: Rows of one chunk at most, about.
CHUNK_ROWS = 8192


def write_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back: lineage ends there, lost executors do no harm."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, by: Sequence[str], key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with ``_part``: the rows of a group dealt by the hash of ``key`` into parts of about ``chunk_rows`` rows; rows with a null group go."""
    n = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_parts"))
    return df.join(n, list(by)).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` dealt by ``keys`` for work that is heavy beside its bytes: into as many partitions as shuffles have, four a core at least,
    which adaptive execution leaves as they are."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def apply_models(rows: DataFrame, models: DataFrame, by: Sequence[str], key: str, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
                 chunk_rows: int = 50_000) -> DataFrame:
    """``fn(rows of a part, models of its group)`` for all parts of all groups: no group meets in one task, each part gets a copy of its group's models."""
    ship_package(rows.sparkSession)
    parts = dealt(rows, by, key, chunk_rows)
    copies = models.join(parts.select(*by, "_parts").distinct(), list(by)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    keys = [*by, "_part"]
    out = spread(parts.drop("_parts"), keys).groupBy(*keys).cogroup(spread(copies.drop("_parts"), keys).groupBy(*keys))

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        return fn(a, b)

    return out.applyInArrow(one, schema)


def packed(df: DataFrame, by: Sequence[str], vec: str, y: str, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows as chunks: ``by, n, x, y, h`` with the vectors (row after row), targets and key hashes as packed little-endian numbers.

    Vectors of a group have one length; rows with a null group, vector or target go.
    """
    ship_package(df.sparkSession)
    src = df.where(F.col(vec).isNotNull() & F.col(y).isNotNull())
    src = src.select(*by, F.col(vec).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), F.xxhash64(key).alias("h"))
    parts = dealt(src, by, "h", chunk_rows).drop("_parts")
    kinds = dict(src.dtypes)
    schema = ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", n int, x binary, y binary, h binary"

    def pack(t: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(t, sort_keys=[("h", "ascending")])
        t = t.take(order)
        flat = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
        cols = {b: t.column(b).slice(0, 1) for b in by}
        return pa.table({**cols, "n": pa.array([t.num_rows], pa.int32()), "x": pa.array([flat(t.column("x"))], pa.binary()),
                         "y": pa.array([t.column("y").to_numpy().astype("<f8").tobytes()], pa.binary()), "h": pa.array([t.column("h").to_numpy().astype("<i8").tobytes()], pa.binary())})

    return parts.groupBy(*by, "_part").applyInArrow(pack, schema)


def each_row(fn: Callable[[dict], list[dict]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from one that takes one row (a dict) and returns rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                got = fn({n: part.column(n)[k].as_py() for n in part.schema.names})
                if got:
                    yield pa.RecordBatch.from_pylist(got, schema=schema)

    return run
