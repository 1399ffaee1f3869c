"""Ordered operators that survive one key holding a large share of the rows.

A plain window sends a whole key to one task. Here the order column is cut into chunks of a fixed
width, each (key, chunk) is a separate task unit, and only one summary row per chunk travels on to the
window over the key. A key whose order values fit in one chunk needs no correction at all, so for
ordinary data the correction side is empty and the runtime re-plan turns its join into nothing.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WIDTH = 1 << 16


def _chunk(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = WIDTH,
                inclusive: bool = True) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to this row; ``order`` must be unique within a key."""
    d = df.withColumn("_ck", _chunk(order, width)).withColumn("_v", value)
    part = W.partitionBy(*keys, "_ck").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    totals = d.groupBy(*keys, "_ck").agg(F.sum("_v").alias("_t"))
    earlier = W.partitionBy(*keys).orderBy("_ck").rowsBetween(W.unboundedPreceding, -1)
    fix = totals.select(*keys, "_ck", F.sum("_t").over(earlier).alias("_b")).filter("_b is not null")
    d = d.withColumn("_s", F.coalesce(F.sum("_v").over(part), F.lit(0)))
    return (d.join(fix, [*keys, "_ck"], "left")
            .withColumn(out, F.col("_s") + F.coalesce("_b", F.lit(0))).drop("_ck", "_v", "_s", "_b"))


def position(df: DataFrame, keys: list[str], order: str, out: str = "idx", width: int = WIDTH) -> DataFrame:
    """0-based position of each row within its key."""
    return (running_sum(df, keys, order, F.lit(1), out, width, inclusive=True)
            .withColumn(out, (F.col(out) - 1).cast("bigint")))


def previous(df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    """Last non-null ``value`` of the rows before this one in its key (a lag that skips nulls)."""
    d = df.withColumn("_ck", _chunk(order, width)).withColumn("_v", value)
    before = W.partitionBy(*keys, "_ck").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    # max_by skips rows without an ordering value, so this is the chunk's last non-null value.
    tails = d.groupBy(*keys, "_ck").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_t"))
    earlier = W.partitionBy(*keys).orderBy("_ck").rowsBetween(W.unboundedPreceding, -1)
    fix = (tails.select(*keys, "_ck", F.last("_t", ignorenulls=True).over(earlier).alias("_b"))
           .filter("_b is not null"))
    d = d.withColumn("_s", F.last("_v", ignorenulls=True).over(before))
    return (d.join(fix, [*keys, "_ck"], "left").withColumn(out, F.coalesce("_s", "_b"))
            .drop("_ck", "_v", "_s", "_b"))
