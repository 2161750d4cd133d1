"""Run a registered query and its SQL over the same tables and compare the rows."""

import glob
import os

import duckdb
import pandas as pd


def normal(p: pd.DataFrame) -> pd.DataFrame:
    p = p[sorted(p.columns)].copy()
    for c in p.columns:
        if p[c].dtype.kind == "f":
            p[c] = p[c].round(6)
        elif "datetime" in str(p[c].dtype):
            p[c] = p[c].astype("datetime64[us]").astype(str)
        p[c] = p[c].map(lambda v: "NULL" if v is None or v != v else str(v))
    return p.sort_values(list(p.columns)).reset_index(drop=True)


def both(spark, d: str, query, sql: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return normal(query(spark, d).toPandas()), normal(con.execute(sql).df())
