"""Runs a query and its SQL on the same tables and compares them, whatever their order."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(sql: str, sf_dir: str | None = None, **tables) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet") if sf_dir else []:
        name = os.path.basename(path)[:-8]
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name} as select * from read_parquet('{files}')")
    for name, data in tables.items():
        con.register(name, data)
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def tidy(rows, columns, names) -> list[tuple]:
    at = [columns.index(n) for n in names]
    return sorted(tuple(repr(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in at) for r in rows)


def assert_same(df, sql: str, sf_dir: str | None = None, **tables) -> int:
    columns, want = duck(sql, sf_dir, **tables)
    names = sorted(columns)
    assert names == sorted(df.columns)
    got = tidy([tuple(r) for r in df.collect()], df.columns, names)
    assert got == tidy(want, columns, names)
    return len(got)
