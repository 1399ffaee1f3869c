"""Texts shown to a reader, as column expressions."""

from pyspark.sql import Column, functions as F


def distance(meters: Column) -> Column:
    km = meters / 1000
    return (F.when(meters < 1000, F.concat(F.floor(meters + 0.5).cast("string"), F.lit(" m")))
            .when(km >= 100, F.concat(F.floor(km + 0.5).cast("string"), F.lit(" km")))
            .otherwise(F.concat(F.format_string("%.1f", km.cast("double")), F.lit(" km"))))


def duration(seconds: Column) -> Column:
    total = F.greatest(F.lit(1), F.floor(seconds / 60 + 0.5))
    h, m = F.floor(total / 60).cast("string"), (total % 60).cast("string")
    return (F.when(total < 60, F.concat(m, F.lit(" min"))).when(total % 60 == 0, F.concat(h, F.lit(" h")))
            .otherwise(F.concat(h, F.lit(" h "), m, F.lit(" min"))))


def fare(currency: Column, amount: Column) -> Column:
    a = amount.cast("string")
    return (F.when(amount.isNull(), "Fare unavailable").when(currency == "INR", F.concat(F.lit("₹"), a))
            .otherwise(F.concat(currency, F.lit(" "), a)))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def transfers(n: Column) -> Column:
    return F.when(n <= 0, "Direct").otherwise(counted(n, "transfer", "transfers"))
