"""Runs a query on Spark and its SQL on DuckDB and compares columns, types and rows."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

from assay.plans.queries import TABLES

_KINDS = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "huge", "UBIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "time"}
_SPARK = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "double": "float", "float": "float", "string": "string", "boolean": "bool", "date": "date", "timestamp": "time", "timestamp_ntz": "time"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def difference(spark, con, fn, sql: str, sf: str) -> str | None:
    """None if both agree, else what differs."""
    got = fn(spark, sf)
    rel = con.sql(sql)
    cols = sorted(got.columns)
    if cols != sorted(rel.columns):
        return f"columns {cols} and {sorted(rel.columns)}"
    a = {c: _SPARK.get(k, k) for c, k in got.dtypes}
    b = {c: _KINDS.get(str(k), str(k)) for c, k in zip(rel.columns, rel.types, strict=True)}
    if a != b:
        return f"types {[(c, a[c], b[c]) for c in cols if a[c] != b[c]]}"
    x = Counter(tuple(_value(r[c]) for c in cols) for r in got.collect())
    at = [rel.columns.index(c) for c in cols]
    y = Counter(tuple(_value(r[i]) for i in at) for r in rel.fetchall())
    if x != y:
        return f"{sum(x.values())} and {sum(y.values())} rows; only Spark {list((x - y).items())[:3]}; only SQL {list((y - x).items())[:3]}"
    return None
