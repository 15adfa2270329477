"""Run a registered query in Spark and its SQL in DuckDB on the same parquet files; compare
row count, column names and an order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math

import duckdb
import pandas as pd

from courtline.sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (pd.Timestamp,)):
        return v.isoformat()
    return str(v)


def frame_hash(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark, q, sf_dir: str, con=None):
    sdf = q.fn(spark, sf_dir).toPandas()
    con = con or duck(sf_dir)
    ddf = con.execute(q.sql).fetchdf()
    out = {"rows": (len(sdf), len(ddf)), "cols": (sorted(sdf.columns), sorted(ddf.columns))}
    out["ok"] = (len(sdf) == len(ddf) and sorted(sdf.columns) == sorted(ddf.columns)
                 and frame_hash(sdf) == frame_hash(ddf))
    return out, sdf, ddf
