"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return repr(value + 0.0) if isinstance(value, float) else repr(value)


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(df, sql, con):
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert mine == theirs
    return len(mine)
