"""Comparing a query's rows with DuckDB's."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def plain(x):
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    try:
        return repr(round(float(x), 9))
    except (TypeError, ValueError):
        return str(x)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(plain(x) for x in r) for r in pdf[cols].itertuples(index=False))
