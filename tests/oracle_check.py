"""Runs queries against their SQL in DuckDB: ``python tests/oracle_check.py [sf_dir] [name...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(normal(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def connect(root: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in sorted(Path(root).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return c


def compare(spark, c, root, name, query, sql) -> str:
    df = query(spark, root)
    t = time.time()
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    cur = c.execute(sql)
    want, cols = cur.fetchall(), [d[0] for d in cur.description]
    if sorted(cols) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"{name}: {len(a)} rows, SQL {len(b)}; first difference {str(diff)[:600]}"
    return f"ok {name}: {len(a)} rows in {took:.1f} s"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from codequarry.session import local_session

    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    c = connect(root)
    qs, sql = entry.queries(), entry.oracle_sql()
    for name in names or qs:
        try:
            if name in sql:
                print(compare(spark, c, root, name, qs[name], sql[name]), flush=True)
            else:
                t = time.time()
                n = qs[name](spark, root).count()
                print(f"rows-only {name}: {n} in {time.time() - t:.1f} s", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
