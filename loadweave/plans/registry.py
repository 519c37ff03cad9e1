"""Queries by name, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison (all of them if none is named)."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in names})


def stirred(x: str) -> str:
    """The bootstrap's mixing of a number, as SQL."""
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * 73244475) % 4294967296)"
    return f"xor({x}, {x} >> 16)"
