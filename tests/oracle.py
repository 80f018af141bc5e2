"""Spark's rows and DuckDB's rows of a registered query, in a common order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def oracle_rows(con, sql, names):
    found = con.execute(sql)
    own = [x[0] for x in found.description]
    assert sorted(own) == names
    return sorted((tuple(row[own.index(c)] for c in names) for row in found.fetchall()), key=repr)
