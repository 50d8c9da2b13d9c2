"""Comparing a query with its SQL on a directory of sample tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

import __spark_entry__ as contract

TABLES = ("region", "nation", "customer", "events")


def duck_on(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    """NaN equals NaN here."""
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def _multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = tuple(columns[i] for i in order)
    return Counter((names, *(_plain(row[i]) for i in order)) for row in rows)


def oracle_rows(con, name: str) -> Counter:
    found = con.execute(contract.oracle_sql()[name])
    return _multiset([c[0] for c in found.description], found.fetchall())


def spark_rows(df) -> Counter:
    return _multiset(df.columns, [tuple(r) for r in df.collect()])
