"""A Spark query's result against its SQL on DuckDB."""

import glob
import os

import duckdb


def connect(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    shown = [[f"{x:.6g}" if isinstance(x, float) else str(x) for x in frame[c].where(frame[c].notna(), None)] for c in frame.columns]
    return sorted(zip(*shown)) if shown else []
