"""Comparison of a query with its SQL on the same Parquet files."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return f"{x:.6f}" if isinstance(x, float) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(tuple(plain(r[i]) for i in order) for r in data)


def differences(df, con, sql):
    cur = con.execute(sql)
    a, b = rows(df.columns, df.collect()), rows([c[0] for c in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        x, y = set(a[1]), set(b[1])
        return f"{len(a[1])} and {len(b[1])} rows; only Spark {sorted(x - y)[:3]}, only SQL {sorted(y - x)[:3]}"
    return "" if a[1] else "no rows"
