"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Decimals to which queries present doubles; operators themselves never round.
DECIMALS = 6


def query(name: str, sql: str | None = None, doubles: tuple[str, ...] = (), decimals: int = DECIMALS):
    """Registers f(spark, sf_dir) under name; doubles: the columns that are presented rounded, here and in the SQL."""

    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.round(c, decimals) + F.lit(0.0) for c in doubles})

        QUERIES[name] = run
        if sql:
            shown = ", ".join(f"round({c}, {decimals}) + 0.0::DOUBLE AS {c}" for c in doubles)
            SQL[name] = f"SELECT * REPLACE ({shown}) FROM ({sql})" if doubles else sql
        return run

    return register
