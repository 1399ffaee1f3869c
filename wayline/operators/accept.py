"""The import rule shared by every table: a row is accepted, skipped, a duplicate, or rejected with a reason.

The first acceptable row of an id wins. It is found by a minimum per id (combined map-side) and joined
back, so an id repeated millions of times never gathers in one task: the runtime skew split applies.
"""

from pyspark.sql import Column, DataFrame, functions as F

DUPLICATE = "duplicate"
SKIPPED = "skipped"


def reasons(*rules: tuple[Column, str]) -> Column:
    """First matching reason, in order; NULL when the row is fine."""
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in rules])


def _ruled(df: DataFrame, reason: Column, always: Column | None, skip: Column | None) -> DataFrame:
    d = df.withColumn("_always", always if always is not None else F.lit(None).cast("string"))
    d = d.withColumn("_skip", F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False))
    return d.withColumn("_why", reason)


def acceptable(df: DataFrame, key: list[str], pos: str, reason: Column, always: Column | None = None, skip: Column | None = None) -> DataFrame:
    """The rows without a fault of their own, of which :func:`judge` accepts the first of each key."""
    d = _ruled(df, reason, always, skip)
    return d.filter(F.col("_always").isNull() & ~F.col("_skip") & F.col("_why").isNull()).drop("_always", "_skip", "_why")


def accepted_keys(df: DataFrame, key: list[str], pos: str, reason: Column, always: Column | None = None, skip: Column | None = None) -> DataFrame:
    """The distinct keys of the rows that :func:`judge` accepts: a key with an acceptable row has a first one, so no row is joined back."""
    return acceptable(df, key, pos, reason, always, skip).select(*key).distinct()


def judge(df: DataFrame, key: list[str], pos: str, reason: Column, always: Column | None = None,
          skip: Column | None = None, skip_blocks: bool = False, late_duplicate: bool = False) -> DataFrame:
    """Adds ``outcome`` (accepted / skipped / duplicate / rejected) and ``reason``.

    ``always`` is a reason that is tested before the duplicate rule (a blank id). ``skip`` rows are
    neither accepted nor rejected; with ``skip_blocks`` their id also makes later rows duplicates.
    ``late_duplicate`` reports a bad later copy under its own reason instead of as a duplicate.
    """
    d = _ruled(df, reason, always, skip)
    wins = F.col("_always").isNull() & ((~F.col("_skip") & F.col("_why").isNull())
                                        | (F.col("_skip") if skip_blocks else F.lit(False)))
    first = d.filter(wins).groupBy(*key).agg(F.min(pos).alias("_first"))
    d = d.join(first, key, "left")
    later = F.col("_first").isNotNull() & (F.col(pos) > F.col("_first"))
    if late_duplicate:
        later = later & F.col("_why").isNull()
    outcome = (F.when(F.col("_always").isNotNull(), "rejected").when(later, DUPLICATE)
               .when(F.col("_skip"), SKIPPED).when(F.col("_why").isNotNull(), "rejected").otherwise("accepted"))
    d = d.withColumn("outcome", outcome)
    return (d.withColumn("reason", F.when(F.col("outcome") == "rejected", F.coalesce("_always", "_why")))
            .drop("_always", "_skip", "_why", "_first"))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("outcome") == "accepted").drop("outcome", "reason")


def tally(df: DataFrame, table: str) -> DataFrame:
    """Rows per outcome and reason."""
    return (df.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(table).alias("tbl"), "outcome", F.coalesce("reason", F.lit("")).alias("reason"), "n"))
