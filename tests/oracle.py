"""Holds registered queries against their SQL: python -m tests.oracle [SF_DIR] [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    return con


def difference(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if the rows are the same, whatever their order."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(map(canonical, r)) for r in df.select(*[f"`{n}`" for n in names]).collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    want = sorted(tuple(map(canonical, r)) for r in rel.project(", ".join(f'"{n}"' for n in names)).fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    odd = [(a, b) for a, b in zip(got, want) if a != b]
    if odd:
        return f"{len(odd)} of {len(got)} rows differ, first {odd[0]}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    swap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = [(n, t, kinds[n]) for n, t in df.dtypes if t in swap and kinds[n] != swap[t]]
    return f"types differ: {off}" if off else ""


if __name__ == "__main__":
    import __spark_entry__ as entry

    from tests.session import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or list(queries):
        began = time.time()
        if name not in sql:
            print(f"{name}: {queries[name](spark, sf_dir).count()} rows, no SQL, {time.time() - began:.1f} s", flush=True)
            continue
        try:
            said = difference(spark, con, name, queries[name], sql[name], sf_dir)
        except Exception as e:  # the next query is still compared
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name}: {said or 'same'}, {time.time() - began:.1f} s", flush=True)
