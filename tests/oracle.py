"""Comparison of a query with its DuckDB twin."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str = DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(found.fetchall(), columns)
