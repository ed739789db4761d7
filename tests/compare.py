"""Run a registered query and its SQL side by side and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
         "date": "DATE"}


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    problems = []
    cur = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    theirs = cur.fetchall()
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for name, kind in df.dtypes:
        if KINDS.get(kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} vs {kinds[name]}")
    ours = [tuple(r) for r in df.collect()]
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} vs {len(theirs)}")
    a, b = _rows(df.columns, ours), _rows(names, theirs)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        problems.append(f"values differ ({sorted(names)}): spark {str(only_a)[:600]} sql {str(only_b)[:600]}")
    elif not a:
        problems.append("both empty")
    return problems


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from sparkaudit.session import build_session

    folder, *wanted = sys.argv[1:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in oracle:
                found = compare(df, con, oracle[name])
            else:
                found = [] if df.count() >= 0 else ["no rows"]
        except Exception as exc:  # noqa: BLE001
            found = [f"{type(exc).__name__}: {str(exc)[:900]}"]
        took = time.time() - t0
        bad += bool(found)
        if found or took > 4 or wanted:
            print(f"{'BAD ' if found else 'ok  '} {name} {took:.1f}s {'' if name in oracle else '(no sql)'}", *found,
                  sep="\n      ")
    print("queries", len(entry.queries()), "with sql", len(oracle), "bad", bad)
