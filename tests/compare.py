"""Result tables as sorted rows of columns in name order, for Spark and DuckDB alike."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (np.generic,)):
        v = v.item()
    if isinstance(v, float):
        return "nan" if v != v else v
    return v


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_plain(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def duck(sql: str, folder: str = DATA) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    return sorted(cols), canonical(pd.DataFrame.from_records(cur.fetchall(), columns=cols))


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), canonical(pd.DataFrame.from_records([tuple(r) for r in df.collect()], columns=df.columns))
