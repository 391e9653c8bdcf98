"""Compares a query's rows with its SQL's."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def compare(df, con, sql: str) -> None:
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else v + 0.0
        return v

    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    at = [want.columns.index(c) for c in names]
    expected = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert got == expected, f"{len(got - expected)} rows only here, {len(expected - got)} only there: {list((got - expected).items())[:3]} {list((expected - got).items())[:3]}"
