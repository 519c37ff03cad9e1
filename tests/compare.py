"""Rows of a Spark result and of a DuckDB result as sorted text, for comparison."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "~"
    kind = type(v).__name__
    if "bool" in kind:
        return str(bool(v))
    if "int" in kind:
        return str(int(v))
    return f"{v:.9g}" if "float" in kind else str(v)


def rows(pdf: pd.DataFrame) -> list[str]:
    pdf = pdf.reindex(sorted(pdf.columns), axis=1)
    return sorted("|".join(map(_cell, r)) for r in pdf.itertuples(index=False))
