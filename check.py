"""Run registered queries against their DuckDB twins.

    python check.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from veilspark.plans.registry import oracle_sql, queries
from veilspark.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


def row_key(row, order):
    return tuple(repr(rounded(row[i])) for i in order)


def compare(spark_df, con, sql) -> tuple[bool, str]:
    rows = spark_df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return False, f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    mine_order = [spark_df.columns.index(n) for n in sorted(names)]
    their_order = [names.index(n) for n in sorted(names)]
    a = Counter(row_key(r, mine_order) for r in rows)
    b = Counter(row_key(r, their_order) for r in theirs)
    if a == b:
        return True, f"{len(rows)} rows"
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    cut = lambda rows: [tuple(x[-400:] for x in r) for r in rows[:2]]
    return False, f"{len(rows)} vs {len(theirs)} rows; {len(only_a)} differ\n  ours {cut(only_a)}\n  duck {cut(only_b)}"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, sql = local_session(), duck(folder), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in sql:
                ok, note = compare(df, con, sql[name])
            else:
                ok, note = True, f"{df.count()} rows, no SQL twin"
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
