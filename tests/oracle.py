"""Runs a query's SQL in DuckDB and compares rows without their order."""

import math
from pathlib import Path

import duckdb
import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


def by_sql(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con.execute(sql).df()


def same(got: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)
