"""Rows of a Spark query beside the rows of its SQL in DuckDB."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, query, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA / sf / t}.parquet'")
    ours, theirs = query(spark, str(DATA / sf)), con.sql(sql)
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    expected = theirs.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall()
    assert sorted(repr(tuple(r)) for r in ours.select(*names).collect()) == sorted(map(repr, expected))
