"""Registered queries and their oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def rounded(digits: int, *cols: str | Column) -> list[Column]:
    return [F.round(F.col(c), digits).alias(c) for c in cols]


def made(columns) -> list:
    """Columns given as a list, or as a function where building them needs a running session."""
    return columns() if callable(columns) else columns
