"""Order-insensitive comparison of a Spark result with a DuckDB result (tests and checks)."""

from __future__ import annotations

import datetime as dt
import math

from keepsake.plans.registry import TABLES

_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "smallint": "SMALLINT", "tinyint": "TINYINT",
}


def oracle(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def compare(schema, rows, relation) -> str | None:
    """None when equal, else a short description of the first difference."""
    names = [d[0] for d in relation.description]
    types = {d[0]: str(d[1]) for d in relation.description}
    theirs = relation.fetchall()
    mine = [f.name for f in schema.fields]
    if sorted(mine) != sorted(names):
        return f"columns {sorted(mine)} vs {sorted(names)}"
    wrong = [(f.name, f.dataType.simpleString(), types[f.name]) for f in schema.fields
             if _TYPES.get(f.dataType.simpleString(), "?") != types[f.name]]
    if len(rows) != len(theirs):
        return f"rows {len(rows)} vs {len(theirs)}"
    order = sorted(names)
    at = {n: i for i, n in enumerate(names)}
    a = sorted(tuple(_cell(r[n]) for n in order) for r in rows)
    b = sorted(tuple(_cell(r[at[n]]) for n in order) for r in theirs)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        x, y = diff[0]
        cols = [f"{n}: {str(p)[:160]} vs {str(q)[:160]}" for n, p, q in zip(order, x, y) if p != q]
        return f"{len(diff)} rows differ; first {cols} in {str(x)[:200]}"
    if wrong:
        return f"types {wrong}"
    return None
