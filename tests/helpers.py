"""Comparing a query with its SQL on the same tables."""

import glob
import os

import duckdb
import pandas as pd


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def normal(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.execute(sql).df()
