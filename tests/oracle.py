"""Comparing a query with its SQL on the same parquet files."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def same(df, con, sql: str) -> None:
    """Equal column names and equal rows as multisets, numbers by value."""
    got = df.collect()
    names = sorted(df.columns)
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    want = [dict(zip(have, r)) for r in cur.fetchall()]
    rows = lambda xs: sorted((tuple(cell(x[c]) for c in names) for x in xs), key=repr)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
