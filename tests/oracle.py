"""Rows of a query against rows of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(map(tuple, pdf.where(pdf.notna(), None).astype(str).values.tolist()))


def check(spark, query, sql: str, sf: str) -> None:
    mine, theirs = query(spark, sf).toPandas(), connect(sf).execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
