"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import decimal
import os
from pathlib import Path

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "NaN" if x != x else str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sql: str):
    import duckdb

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}/*.parquet'" if p.is_dir() else f"create view {p.stem} as select * from '{p}'")
    found = c.execute(sql)
    return [x[0] for x in found.description], found.fetchall()


def check(spark, query, sql: str) -> None:
    df = query(spark, DATA)
    names, rows = duck(sql)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, rows)
