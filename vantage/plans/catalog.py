"""Registry of named queries: Spark plan + DuckDB oracle SQL.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and
``ORACLE[name] = sql`` (absent for iterative / model-fitting queries,
which are checked by property tests instead).  Every Spark result is
passed through ``round_doubles`` and every oracle double through ``r6``
so that both sides compare after the same rounding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vantage.plans.reports import round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_PENDING: dict[str, object] = {}


def register(name: str, oracle: str | Callable[[], str] | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            _PENDING[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from vantage.plans import queries, queries_agg, queries_base, queries_ml, queries_models, queries_stats  # noqa: F401

    for name, o in list(_PENDING.items()):
        ORACLE[name] = o() if callable(o) else o
        del _PENDING[name]
