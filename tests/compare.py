"""Compares a Spark result with a DuckDB result, value by value."""

from __future__ import annotations

import duckdb

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events")
_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), v) for v in row))


def difference(df, con, sql: str) -> str | None:
    """None if equal in column names, types, rows and values; else a short text."""
    con.execute(sql)
    described = {d[0]: str(d[1]) for d in con.description}
    names = sorted(described)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} vs {names}"
    kinds = dict(df.dtypes)
    for name in names:
        expected = _TYPES.get(described[name].upper(), described[name])
        if kinds[name] != expected:
            return f"type of {name}: {kinds[name]} vs {expected}"
    order = [d[0] for d in con.description]
    place = [order.index(name) for name in names]
    theirs = _ordered([tuple(row[i] for i in place) for row in con.fetchall()])
    mine = _ordered([tuple(row) for row in df.select(*names).collect()])
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{dict(zip(names, a))} vs {dict(zip(names, b))}"
    return None
