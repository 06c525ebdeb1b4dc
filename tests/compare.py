"""Run registered queries against their DuckDB check queries: python tests/compare.py [sf] [key ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

ROOT = "/root/testdata/"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "∅"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.6g}" if float(v) != int(float(v)) else str(int(v))
        return str(v)

    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, job, sql, folder):
    start = time.time()
    df = job(spark, folder)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    compare.spark_sec = time.time() - start
    if sql is None:
        return True, len(mine[1]), None
    res = con.execute(sql)
    theirs = canonical([d[0] for d in res.description], res.fetchall())
    if mine == theirs:
        return True, len(mine[1]), None
    if mine[0] != theirs[0]:
        return False, len(mine[1]), f"columns {mine[0]} vs {theirs[0]}"
    a, b = set(mine[1]), set(theirs[1])
    return False, len(mine[1]), f"rows {len(mine[1])} vs {len(theirs[1])}; spark only {list(a - b)[:2]}; sql only {list(b - a)[:2]}"


compare.spark_sec = 0.0


def main(argv):
    from palisade.session import ensure_checkpoint_dir, local_session
    import __spark_entry__ as entry

    folder = ROOT + "sf" + (argv[0] if argv else "0.01")
    jobs, sqls = entry.queries(), entry.oracle_sql()
    keys = argv[1:] or list(jobs)
    spark = local_session()
    ensure_checkpoint_dir(spark)
    con = connect(folder)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            ok, n, why = compare(spark, con, jobs[key], sqls.get(key), folder)
        except Exception as e:  # report and go on with the next query
            ok, n, why = False, -1, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        kind = "sql" if key in sqls else "rows"
        print(f"{'ok ' if ok else 'BAD'} {key:32s} {kind:5s} {n:8d} rows {compare.spark_sec:6.1f}s spark {time.time() - start:6.1f}s {why or ''}"[:2500], flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
