"""Run registered queries and their SQL side by side: python -m tests.oracle_check [sf_dir] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
import traceback
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, float):
        return f"float {value!r}"
    if isinstance(value, int):
        return f"int {value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def as_rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str, queries, oracles) -> tuple[str | None, float]:
    """Difference in words (None when equal) and the seconds Spark took."""
    start = time.time()
    df = queries[name](spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if name not in oracles:
        return (None if rows else "no rows"), took
    cursor = con.execute(oracles[name])
    theirs_names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(theirs_names):
        return f"columns {sorted(df.columns)} / {sorted(theirs_names)}", took
    a, b = as_rows(df.columns, rows), as_rows(theirs_names, theirs)
    if a == b:
        return (None if rows else "equal but empty"), took
    left, right = sorted((a - b).elements())[:4], sorted((b - a).elements())[:4]
    lines = [f"rows {len(rows)} / {len(theirs)}  columns {sorted(df.columns)}"]
    return "\n".join(lines + [f"  spark {r}" for r in left] + [f"  duck  {r}" for r in right]), took


def main(argv) -> int:
    from __spark_entry__ import oracle_sql, queries
    from peoplelens.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    q, o = queries(), oracle_sql()
    names = [n for n in q if not argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv[1:])]
    bad = 0
    for n in names:
        try:
            diff, took = compare(spark, con, n, sf_dir, q, o)
        except Exception as e:
            lines = [x for x in traceback.format_exc().splitlines() if "/root/repo" in x][-2:]
            diff, took = f"{type(e).__name__} {str(e)[:500]} {lines}", 0.0
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {n} {took:.1f}s{'' if n in o else ' (rows only)'}"
              + ("" if diff is None else f"\n{diff}"), flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
