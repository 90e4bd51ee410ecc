"""DuckDB beside Spark: rows as sorted tuples of text."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of_sql(sf_dir, sql):
    rel = duck(sf_dir).sql(sql)
    return rel.columns, rel.fetchall()


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names, want = rows_of_sql(sf_dir, sql)
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    key = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert key(got) == key(want)
    return got
