"""Compare registered queries with their SQL checks: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET max_temp_directory_size = '2GB'")
    con.execute("SET temp_directory = '/tmp/compare-spill'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def rows_of(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


def kind(value: object) -> str:
    return "null" if value is None else type(value).__name__


def mismatch(spark, folder: str, con, query, sql: str) -> str | None:
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = lambda c: {tuple(kind(v) for v in r) for r in c}
    if got == want:
        a, b = types(got), types(want)
        if a != b:
            return f"equal values, types differ: {sorted(a - b)[:2]} {sorted(b - a)[:2]}"
        return None
    extra, lost = got - want, want - got
    show = lambda c: [str(r)[:300] for r in list(c)[:3]]
    return f"rows {sum(got.values())} vs {sum(want.values())}; only Spark {sum(extra.values())} {show(extra)}; only SQL {sum(lost.values())} {show(lost)}"


def main() -> None:
    import __spark_entry__ as entry
    from stairwell.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:]
    spark = build_session(8)
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = mismatch(spark, folder, con, query, oracles[name])
            else:
                problem = None if query(spark, folder).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        tag = "ok  " if problem is None else "FAIL"
        print(f"{tag} {name} {time.time() - start:.1f}s {'' if name in oracles else '(rows only) '}{problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
