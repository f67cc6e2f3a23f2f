"""Side-by-side check of a Spark result against DuckDB SQL.

Mirrors the driver's gate: row count, column names, and an
order-insensitive hash of the values with columns sorted by name.
Used by tests and by ``python -m splitcraft.oracle``.
"""
from __future__ import annotations

import hashlib
import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def frame_digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256()
    for line in lines:
        h.update(line.encode())
        h.update(b"\n")
    return sorted(cols), len(rows), h.hexdigest()


_SPARK_TYPES = {"string": "str", "bigint": "int64", "int": "int32", "double": "float64", "boolean": "bool",
                "float": "float32", "smallint": "int16", "tinyint": "int8"}
_DUCK_TYPES = {"VARCHAR": "str", "BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "float64", "BOOLEAN": "bool",
               "FLOAT": "float32", "SMALLINT": "int16", "TINYINT": "int8"}


def spark_types(df) -> dict:
    return {f.name: _SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}


def duckdb_types(sf_dir: str, sql: str) -> dict:
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(sql)
    return {c: _DUCK_TYPES.get(str(t).split("(")[0], str(t)) for c, t in zip(rel.columns, rel.types)}


def duckdb_result(sf_dir: str, sql: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def spark_result(df):
    rows = [tuple(r) for r in df.collect()]
    return list(df.columns), rows


def compare(spark, sf_dir: str, name: str, query_fn, sql: str | None):
    df = query_fn(spark, sf_dir)
    s_cols, s_rows = spark_result(df)
    s = frame_digest(s_cols, s_rows)
    if sql is None:
        return {"name": name, "rows": s[1], "oracle": None}
    d_cols, d_rows = duckdb_result(sf_dir, sql)
    d = frame_digest(d_cols, d_rows)
    types_match = spark_types(df) == duckdb_types(sf_dir, sql)
    return {"name": name, "rows": s[1], "oracle_rows": d[1], "cols_match": s[0] == d[0],
            "types_match": types_match, "match": s == d and types_match,
            "spark_cols": s[0], "oracle_cols": d[0]}
