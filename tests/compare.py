"""Run registered queries beside their SQL on DuckDB: python -m tests.compare SF [name part ...]"""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb

from shelf.sources.bridge import BASE_TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6) if v != int(v) else int(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if got != want:
        only_got = [r for r in got[:200000] if r not in set(want)][:3]
        only_want = [r for r in want[:200000] if r not in set(got)][:3]
        return f"rows {len(got)} vs {len(want)}; spark only {only_got}; sql only {only_want}", len(got)
    return None, len(got)


def main() -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from shelf.session import build

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    parts = sys.argv[2:]
    spark = build(scratch=tempfile.mkdtemp(prefix="spark-"))
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            if name in oracles:
                diff, n = compare(spark, con, sf_dir, fn, oracles[name])
            else:
                diff, n = None, len(fn(spark, sf_dir).collect())
        except Exception as e:  # report and go on
            diff, n = f"{type(e).__name__}: {str(e)[:400]}", -1
        bad += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {name} {n} rows {time.time() - t:.1f}s {'' if name in oracles else '(rows only)'} {diff or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
