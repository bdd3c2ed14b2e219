"""Compares a query with its SQL equivalent: python -m tests.compare SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


def bag(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differ(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same rows."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = bag(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} for {sorted(names)}"
    have = bag(df.columns, [tuple(r) for r in df.collect()])
    if have == want:
        return ""
    return f"{sum(have.values())} rows for {sum(want.values())}; only here {list((have - want).items())[:3]}; missing {list((want - have).items())[:3]}"


def main() -> None:
    import __spark_entry__ as e
    from evidenza.runtime import local_session

    spark, con = local_session(8), connect(sys.argv[1])
    queries, oracle = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or list(queries):
        began = time.time()
        try:
            said = differ(queries[name](spark, sys.argv[1]), con, oracle[name]) if name in oracle else f"no SQL: {len(queries[name](spark, sys.argv[1]).collect())} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
