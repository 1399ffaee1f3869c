"""Collects the library's runnable queries and the SQL that cross-checks each of them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wayline.adapters import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARTS: dict[str, str] = {}  # named sub-queries shared by several cross-checks


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so both engines report one type."""
    return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name)
                       if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f"`{f.name}`") for f in df.schema])


def query(name: str, sql: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` under a name, with the SQL of its cross-check."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: widened(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def oracles() -> dict[str, str]:
    return {k: with_views(v, PARTS) for k, v in ORACLES.items()}
