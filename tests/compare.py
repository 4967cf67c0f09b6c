"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, rows_of(names, cur.fetchall())


SPARK_TO_DUCK = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def compare(spark, con, name: str, sf: str) -> tuple[bool, str]:
    from newslens.plans.registry import ORACLE, QUERIES

    start = time.time()
    df = QUERIES[name](spark, sf)
    got = spark_rows(df)
    took = time.time() - start
    if name not in ORACLE:
        return True, f"rows only: {len(got)} rows, {took:.1f}s"
    cur = con.execute(ORACLE[name])
    types = {d[0]: str(d[1]) for d in cur.description}
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    odd = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if SPARK_TO_DUCK.get(t, t) != types[c]]
    note = f"{len(got)} rows, {took:.1f}s" + (f", types {odd}" if odd else "")
    if got == want:
        return True, note
    only_s = [r for r in got if r not in set(want)][:2]
    only_d = [r for r in want if r not in set(got)][:2]
    return False, f"{note}; duck {len(want)} rows\n   columns {sorted(names)}\n   spark {only_s}\n   duck  {only_d}"


def main() -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from newslens.session import local_session

    sf = sys.argv[1]
    known = list(entry.queries())
    names = sys.argv[2:] or known
    spark = local_session(8)
    con = connect(sf)
    bad = []
    for n in names:
        try:
            ok, note = compare(spark, con, n, sf)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", n, note, flush=True)
        if not ok:
            bad.append(n)
    print(len(names) - len(bad), "of", len(names), "match;", bad)


if __name__ == "__main__":
    main()
