"""DuckDB texts that compute the same results independently of Spark."""

from __future__ import annotations

import functools
import glob
import os

from storelens.oracle import (classify, conditionals, location, parameterised, probability, quality, sampling,
                              summaries, windows)
from storelens.oracle.views import with_views

_MODULES = (summaries, conditionals, quality, windows, location, parameterised, probability, sampling, classify)
_RAW = ("orders", "lineitem", "part", "customer", "supplier")
_SCHEMA_DIRS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1")

# result types at the query boundary, as ``plans.registry.export_types``
_INTEGRAL = ("TINYINT", "SMALLINT", "INTEGER", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT")


def _target(duck_type: str) -> str | None:
    t = duck_type.upper()
    if t.startswith("DECIMAL") or t == "FLOAT":
        return "DOUBLE"
    if t == "DATE":
        return "TIMESTAMP"
    if t in _INTEGRAL:
        return "BIGINT"
    return None


@functools.lru_cache(maxsize=1)
def _schema_connection():
    """In-memory DuckDB with empty copies of the raw tables, to type results."""
    import duckdb
    con = duckdb.connect()
    folder = next((d for d in _SCHEMA_DIRS if glob.glob(os.path.join(d, "*.parquet"))), None)
    if folder is None:
        return None
    for name in _RAW:
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet') LIMIT 0")
    return con


def export_types(sql: str) -> str:
    """Wrap ``sql`` so that its result has the boundary types."""
    con = _schema_connection()
    if con is None:
        return sql
    cols = con.execute(f"DESCRIBE {sql}").fetchall()
    casts = [(name, _target(typ)) for name, typ, *_ in cols]
    casts = [(n, t) for n, t in casts if t]
    if not casts:
        return sql
    repl = ", ".join(f'CAST("{n}" AS {t}) AS "{n}"' for n, t in casts)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS q"


def oracle_texts() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        for k, body in m.SQL.items():
            out[k] = export_types(with_views(body))
    return out
