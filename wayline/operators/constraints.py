"""Constraints a set of tables must meet. Each function returns the rows or keys that break one."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wayline.operators.ordered import previous


def not_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row carries."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def dangling(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows that name a parent which does not exist; NULL names none."""
    return df.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def child_count(parent: DataFrame, child: DataFrame, key: str, fits: Column) -> DataFrame:
    """Parents whose number of ``children`` does not fit."""
    n = child.groupBy(key).agg(F.count(F.lit(1)).alias("children"))
    return parent.join(n, key, "left").withColumn("children", F.coalesce("children", F.lit(0))).filter(~fits)


def gaps(df: DataFrame, key: str, index: str) -> DataFrame:
    """Keys whose distinct index values are not exactly 0, 1, 2, ..."""
    per = df.groupBy(key, index).agg(F.count(F.lit(1)).alias("at")).groupBy(key).agg(
        F.count(F.lit(1)).alias("values"), F.sum("at").alias("rows"), F.min(index).alias("low"), F.max(index).alias("high"))
    return per.filter("low <> 0 or high <> values - 1 or rows <> values")


def falling(df: DataFrame, key: str, order: str, value: str, since: str | None = None, strict: bool = False) -> DataFrame:
    """Rows whose value is below that of the row before (``since``: the column read there); not above it if strict."""
    d = previous(df, [key], order, F.struct(F.col(since or value).alias("value")), "before")
    return d.filter(F.col(value) <= F.col("before.value") if strict else F.col(value) < F.col("before.value"))


def disagreeing(df: DataFrame, parent: DataFrame, key: str, column: str) -> DataFrame:
    """Rows that carry another value than the parent they name."""
    other = parent.select(key, F.col(column).alias("parents"))
    return df.join(other, key).filter(F.col(column) != F.col("parents"))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per constraint with the number of rows or keys that break it."""
    one = lambda name, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")
    return reduce(DataFrame.unionByName, [one(k, d) for k, d in checks.items()])
