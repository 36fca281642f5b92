"""Compare a Spark result with the same result from another engine."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def _clean(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    con_rel = con.execute(sql)
    names = [d[0] for d in con_rel.description]
    other = con_rel.fetchall()
    mine = [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(mine) != len(other):
        return f"{len(mine)} rows != {len(other)}"
    order = sorted(names)
    left = sorted((tuple(_clean(r[spark_df.columns.index(c)]) for c in order) for r in mine), key=repr)
    right = sorted((tuple(_clean(r[names.index(c)]) for c in order) for r in other), key=repr)
    for a, b in zip(left, right):
        for c, x, y in zip(order, a, b):
            if x != y or _kind(x) != _kind(y):
                return f"{c}: {x!r} ({_kind(x)}) != {y!r} ({_kind(y)}) in {a} / {b}"
    return None
