"""Registered queries: a Spark function over a data folder and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Added before rounding: it moves decimal ties, on which the engines' rounding rules differ.
NUDGE = 1e-10


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is the same result in SQL over the tables."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + NUDGE, digits) for n in names})


def sql_half_even(expression: str, digits: int) -> str:
    """``expression``, settled to 12 digits, rounded half to even in decimal arithmetic."""
    scale = 10**digits
    return (
        f"list_transform([cast(round({expression}, 12) AS decimal(30, 12)) * {scale}], lambda v: "
        f"cast((floor(v) + CASE WHEN v - floor(v) > 0.5 OR (v - floor(v) = 0.5 AND floor(v) % 2 <> 0) "
        f"THEN 1 ELSE 0 END) / {scale} AS double))[1]"
    )


def sql_round(expression: str, digits: int = 6) -> str:
    return f"round(({expression}) + 1e-10, {digits})"
