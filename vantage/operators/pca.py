"""Principal components per group, for narrow and wide vectors alike.

Rows are packed into chunks; every task merges the (count, mean, centred Gram
matrix) of its chunks group by group, and a few merge steps end with one such
triple per group, which the eigen-solve runs on.  Merging adds the outer
product of the difference of means, so numbers far from zero lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.operators.chunked import apply_models, packed, write_once
from vantage.operators.trees import arrow_schema
from vantage.session import ship_package

#: Numbers of one chunk and bytes of merged matrices a task holds before it passes them on.
CHUNK_NUMBERS, HELD_BYTES = 2_000_000, 64 << 20


def moments(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    mean = x.mean(0)
    c = x - mean
    # the mean of the centred rows takes off what rounding of ``mean`` left
    rest = c.mean(0)
    return float(len(x)), mean + rest, c.T @ c - len(x) * np.outer(rest, rest)


def merged(a: tuple[float, np.ndarray, np.ndarray], b: tuple[float, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def axes(gram: np.ndarray, n: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top ``k`` axes (rows) and their variances; the largest loading of an axis is positive."""
    w, v = np.linalg.eigh(gram / max(n - 1.0, 1.0))
    order = np.argsort(w)[::-1][:k]
    comp = v[:, order].T.copy()
    for c in comp:
        if c[np.argmax(np.abs(c))] < 0:
            c *= -1.0
    return comp, np.maximum(w[order], 0.0)


def grouped_moments(df: DataFrame, by: Sequence[str], key: str, vec: str, dim: int | None = None) -> DataFrame:
    """``by, n, mean array<double>, gram binary``: count, mean and centred Gram matrix (packed doubles) per group."""
    by = list(by)
    spark = df.sparkSession
    ship_package(spark)
    src = df.dropna(subset=[*by, vec])
    width = dim or src.agg(F.max(F.size(vec))).first()[0] or 1
    chunks = write_once(packed(src.withColumn("_y", F.lit(0.0)), by, vec, "_y", key, max(64, CHUNK_NUMBERS // width)), "pca-chunks")
    names = ", ".join(f"`{b}` {t}" for b, t in chunks.select(*by).dtypes)
    schema = f"{names}, _salt int, n double, mean array<double>, gram binary"
    as_part = arrow_schema(df, schema)

    def rows_of(held: dict, salt: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**dict(zip(by, k)), "_salt": salt, "n": n, "mean": m.tolist(), "gram": g.tobytes()} for k, (n, m, g) in held.items()], schema=as_part)

    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt, held, size = TaskContext.get().partitionId() % 64, {}, 0
        for part in parts:
            for i in range(part.num_rows):
                k = tuple(part.column(b)[i].as_py() for b in by)
                got = moments(np.frombuffer(part.column("x")[i].as_py(), "<f8").reshape(part.column("n")[i].as_py(), -1))
                size += 0 if k in held else got[2].nbytes
                held[k] = merged(held[k], got) if k in held else got
                if size > HELD_BYTES:
                    yield rows_of(held, salt)
                    held, size = {}, 0
        if held:
            yield rows_of(held, salt)

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key_of = None, None
        for part in parts:
            for i in range(part.num_rows):
                key_of = {b: part.column(b)[i].as_py() for b in [*by, "_salt"]}
                mean = np.array(part.column("mean")[i].as_py())
                got = part.column("n")[i].as_py(), mean, np.frombuffer(part.column("gram")[i].as_py(), "<f8").reshape(len(mean), len(mean))
                total = got if total is None else merged(total, got)
        if total is not None:
            yield pa.RecordBatch.from_pylist([{**key_of, "n": total[0], "mean": total[1].tolist(), "gram": total[2].tobytes()}], schema=as_part)

    parts = chunks.mapInArrow(first, schema)
    salted = parts.groupBy(*by, "_salt").applyInArrow(merge, schema)
    return salted.groupBy(*by).applyInArrow(merge, schema).drop("_salt")


def pca(df: DataFrame, by: Sequence[str], id_col: str, vec: str, dim: int | None = None, k: int = 50):
    """Centre and project each group on its top ``min(k, rows, width)`` axes: ``(scores, components)``.

    ``scores``: ``by, id_col, scores``; ``components``: ``by, mean, components,
    explained``.  Rows without group or vector are left out.  ``dim``: the
    width of the vectors, if known (saves a pass).
    """
    by = list(by)
    mom = grouped_moments(df, by, id_col, vec, dim)
    names = ", ".join(f"`{b}` {t}" for b, t in mom.select(*by).dtypes)
    schema = f"{names}, mean array<double>, components array<array<double>>, explained array<double>"
    as_comp = arrow_schema(df, schema)

    def solve(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                d = len(r["mean"])
                comp, var = axes(np.frombuffer(r["gram"], "<f8").reshape(d, d), r["n"], int(min(k, r["n"], d)))
                yield pa.RecordBatch.from_pylist([{**{b: r[b] for b in by}, "mean": r["mean"], "components": comp.tolist(), "explained": var.tolist()}], schema=as_comp)

    comp = write_once(mom.mapInArrow(solve, schema), "pca-components")
    kinds = dict(df.dtypes)

    def project(t: pa.Table, m: pa.Table) -> pa.Table:
        n = t.num_rows if m.num_rows else 0
        out: list = []
        if n:
            x = t.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            c = m.to_pylist()[0]
            out = list((x - np.array(c["mean"])) @ np.array(c["components"]).T)
        t = t.slice(0, n)
        return pa.table({**{c: t.column(c) for c in [*by, id_col]}, "scores": pa.array(out, pa.list_(pa.float64()))})

    src = df.select(*by, id_col, F.col(vec).cast("array<double>").alias("_x")).where(F.col("_x").isNotNull())
    out = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, id_col]) + ", scores array<double>"
    return apply_models(src, comp, by, id_col, project, out), comp
