"""Run registered queries and their SQL twins on one scale factor and report differences.

usage: python tools/compare.py SF_DIR [name ...]
"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from moneytrail.plans.oracle import ORACLE  # noqa: E402
from moneytrail.plans.queries import QUERIES  # noqa: E402
from moneytrail.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return str(v)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name):
    """``(spark rows, seconds, sql seconds, problem or None)``."""
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    collected = [tuple(r) for r in df.collect()]
    took = time.time() - start
    mine = rows_of(df.columns, collected)
    if name not in ORACLE:
        return len(collected), took, None, None
    start = time.time()
    result = con.execute(ORACLE[name])
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    sql_took = time.time() - start
    if mine[0] != theirs[0]:
        return len(collected), took, sql_took, f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        detail = f"rows {len(mine[1])} / {len(theirs[1])}; only here {str(sorted(a - b)[:2])[:400]}; only there {str(sorted(b - a)[:2])[:400]}"
        return len(collected), took, sql_took, detail
    return len(collected), took, sql_took, None


if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            n, took, sql_took, problem = compare(spark, con, sf_dir, name)
        except Exception as error:
            n, took, sql_took, problem = 0, 0, None, f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        sql_text = "no sql" if sql_took is None else f"{sql_took:.2f}s"
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} {n:8d} rows {took:6.2f}s  sql {sql_text}  {problem or ''}", flush=True)
    print("differences:", bad)
