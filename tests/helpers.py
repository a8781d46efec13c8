"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        return str(v) if isinstance(v, (str, bool)) else repr(round(float(v), 5)) if hasattr(v, "__float__") else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def by_sql(sql: str, sf: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con.sql(sql).df()
