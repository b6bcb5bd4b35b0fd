"""Queries and their oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistra.sources.fixture import DET_SQL, GOLD_SQL, OBS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name; ``oracle`` is the same query in DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(c: Column) -> Column:
    """Rounded to six places as DuckDB does it, for results that two engines compute: the millionfold is rounded, not the decimal digits."""
    return F.round(c.cast("double") * 1e6) / 1e6 + F.lit(0.0)


def with_obs(sql: str) -> str:
    return f"WITH RECURSIVE {DET_SQL}, {OBS_SQL}{sql}"


def with_gold(sql: str) -> str:
    return f"WITH RECURSIVE {DET_SQL}, {OBS_SQL}, {GOLD_SQL}{sql}"
