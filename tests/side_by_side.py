"""Run registered queries in Spark and their SQL in DuckDB on the same files and compare."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """(n_rows, problem or None)."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return len(got), f"{len(got)} rows, expected {len(want)}"
    a, b = _normal(df.columns, got), _normal(columns, want)
    for x, y in zip(a, b):
        if x != y:
            return len(got), f"columns {sorted(columns)}: {x} != {y}"
    kinds = {type(v) for v in (got[0] if got else ())}
    if kinds & {list, dict}:
        return len(got), "nested output column"
    return len(got), None


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from recordloom.session import local_session

    sf_dir = argv[0]
    spark, con = local_session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(a in n for a in argv[1:])]
    bad = 0
    for name in names:
        start = time.time()
        try:
            n, problem = compare(spark, con, sf_dir, queries[name], oracle.get(name))
        except Exception as e:  # report and go on with the next query
            n, problem = -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        kind = "sql" if name in oracle else "rows-only"
        print(f"{'FAIL' if problem else 'ok':4} {name:34} {kind:9} rows={n:<7} "
              f"{time.time() - start:6.2f}s {(problem or '')[:900]}", flush=True)
    print(f"{len(names)} queries, {bad} failed; oracle without query: {set(oracle) - set(queries)}")


if __name__ == "__main__":
    main(sys.argv[1:])
