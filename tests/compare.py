"""Run registered queries and compare them with their SQL twins in DuckDB.

    python -m tests.compare [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in data), key=lambda t: tuple((x is not None, str(x)) for x in t))


def mismatch(df, sql: str, con) -> str | None:
    """None when both sides agree, else what differs."""
    got = [tuple(x) for x in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            n = sum(1 for p, q in zip(a, b) if p != q)
            return f"{n}/{len(a)} rows differ, columns {sorted(names)}: first {x} != {y}"
    kinds_a = [type(v).__name__ for v in a[0]] if a else []
    kinds_b = [type(v).__name__ for v in b[0]] if b else []
    if kinds_a != kinds_b and None not in (a[0] if a else ()):
        return f"types {kinds_a} != {kinds_b} for {sorted(names)}"
    return None


def main(argv: list[str]) -> int:
    from panelforge.plans import catalog
    from panelforge.session import get_spark

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con, bad = get_spark(), duck(sf_dir), []
    for name, q in catalog.load().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            df = q.build(spark, sf_dir)
            problem = mismatch(df, q.sql, con) if q.sql else None
            n = None if q.sql else df.count()
        except Exception as e:  # report every query, whatever breaks
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", None
            if "-v" in argv:
                traceback.print_exc()
        spark.catalog.clearCache()
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if n is None else f'rows={n}'} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
