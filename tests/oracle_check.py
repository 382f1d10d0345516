"""Compare registered Spark queries with their DuckDB oracle (the driver's check).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from vantage.sources.testdata import TABLES  # noqa: E402


def duck_con(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    return v


def rows_of(records, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in records), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    pdf = sdf.toPandas()
    ts = time.time() - t0
    if sql is None:
        return True, f"{name}: rows={len(pdf)} (no oracle) {ts:.1f}s"
    t1 = time.time()
    ddf = con.execute(sql).fetchdf()
    td = time.time() - t1
    sc, dc = sorted(pdf.columns), sorted(ddf.columns)
    if sc != dc:
        return False, f"{name}: columns differ spark={sc} duck={dc}"
    a = rows_of(pdf.astype(object).where(pdf.notna(), None).to_dict("records"), sc)
    b = rows_of(ddf.astype(object).where(ddf.notna(), None).to_dict("records"), sc)
    if len(a) != len(b):
        return False, f"{name}: rows spark={len(a)} duck={len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{name}: {len(bad)} rows differ, e.g.\n  spark={bad[0][0]}\n  duck ={bad[0][1]}"
    return True, f"{name}: OK rows={len(a)} spark {ts:.1f}s duck {td:.1f}s"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from vantage import get_session
    from vantage.plans.catalog import ORACLE, QUERIES, load_all
    load_all()
    spark = get_session()
    con = duck_con(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            ok, msg = compare(spark, con, name, fn, ORACLE.get(name), sf_dir)
        except Exception as e:  # report and go on
            ok, msg = False, f"{name}: ERROR {type(e).__name__}: {str(e)[:400]}"
        failed += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"failed={failed}")


if __name__ == "__main__":
    main()
