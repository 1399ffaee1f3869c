"""The pattern layer: trips of a route that call at the same stops in the same order, with typical times."""

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from wayline.functions.scalars import pattern_id
from wayline.operators.ordered import position
from wayline.operators.stage import stage


def known_time(first: str = "departure_s", second: str = "arrival_s") -> Column:
    return F.coalesce(F.col(first), F.col(second))


def signatures(stop_times: DataFrame) -> DataFrame:
    """One row per trip whose times are all known and that has at least two stops."""
    return (stop_times.groupBy("trip_id").agg(
        F.md5(F.expr("listagg(CAST(stop_id AS STRING), ',') WITHIN GROUP (ORDER BY stop_sequence)")).alias("signature"),
        F.count(F.lit(1)).alias("stops"),
        F.min_by(known_time(), "stop_sequence").alias("first_departure"),
        F.bool_and(known_time().isNotNull()).alias("timed"))
        .filter((F.col("stops") >= 2) & F.col("timed")).drop("timed"))


def _only_value(c: str) -> Column:
    """The value every trip of the group carries, or NULL."""
    return F.when(F.bool_and(F.col(c).isNotNull()) & (F.min(c) == F.max(c)), F.min(c)).alias(c)


def patterns(signed: DataFrame, trips: DataFrame, source: str = "BUS") -> DataFrame:
    return (signed.join(trips.select("trip_id", "route_id", "direction_id", "headsign"), "trip_id")
            .groupBy("route_id", "signature")
            .agg(F.max("stops").alias("stop_count"), F.count(F.lit(1)).alias("trip_count"),
                 F.min("first_departure").alias("first_departure"), F.max("first_departure").alias("last_departure"),
                 _only_value("direction_id"), _only_value("headsign"))
            .withColumn("pattern_id", pattern_id(F.lit(source), F.col("route_id").cast("string"), F.col("signature"))))


def trip_patterns(signed: DataFrame, trips: DataFrame, source: str = "BUS") -> DataFrame:
    """Every trip with its pattern id (NULL when it has none).

    The id is a function of route and signature, so the pattern table itself is not read back.
    """
    pid = pattern_id(F.lit(source), F.col("route_id").cast("string"), F.col("signature"))
    return (trips.join(signed.select("trip_id", "signature", "first_departure"), "trip_id", "left")
            .withColumn("pattern_id", F.when(F.col("signature").isNotNull(), pid)))


def timed_positions(stop_times: DataFrame) -> DataFrame:
    return position(stop_times, ["trip_id"], "stop_sequence")


def pattern_stops(stop_times: DataFrame, signed: DataFrame, trips: DataFrame, source: str = "BUS") -> DataFrame:
    pid = pattern_id(F.lit(source), F.col("route_id").cast("string"), F.col("signature"))
    off = known_time("arrival_s", "departure_s") - F.col("first_departure")
    return (timed_positions(stop_times).join(signed.select("trip_id", "signature", "first_departure"), "trip_id")
            .join(trips.select("trip_id", "route_id"), "trip_id")
            .groupBy("route_id", "signature", "idx", "stop_id")
            .agg(F.min("stop_sequence").alias("stop_sequence"),
                 F.greatest(F.lit(0), F.round(F.avg(off))).cast("bigint").alias("offset_s"))
            .withColumn("pattern_id", pid))


def expected_wait(trip_count: Column, first: Column, last: Column) -> Column:
    half = F.try_divide(last - first, trip_count - 1) / 2
    return F.when((trip_count >= 2) & (last > first),
                  F.greatest(F.lit(120.0), F.least(F.lit(900.0), half)).cast("bigint")).otherwise(F.lit(900))


def stops_served(pattern_stop: DataFrame, active: DataFrame) -> DataFrame:
    """Distinct active patterns per stop."""
    return (pattern_stop.join(active.select("pattern_id"), "pattern_id", "left_semi")
            .select("stop_id", "pattern_id").distinct().groupBy("stop_id").agg(F.count(F.lit(1)).alias("serving")))


def usable_patterns(pattern: DataFrame, pattern_stop: DataFrame, stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Patterns whose route and every stop are active."""
    broken = (pattern_stop.join(stops.filter("active").select("stop_id"), "stop_id", "left_anti")
              .select("pattern_id").distinct())
    return (pattern.join(routes.filter("active").select("route_id"), "route_id", "left_semi")
            .join(broken, "pattern_id", "left_anti"))


class Layer:
    """The derived pattern tables of one timetable; each is written once, on first use."""

    def __init__(self, stop_times: DataFrame, trips: DataFrame):
        self._times, self._trips = stop_times, trips

    @cached_property
    def signatures(self) -> DataFrame:
        return stage(signatures(self._times))

    @cached_property
    def patterns(self) -> DataFrame:
        return stage(patterns(self.signatures, self._trips))

    @cached_property
    def stops(self) -> DataFrame:
        return stage(pattern_stops(self._times, self.signatures, self._trips))

    @cached_property
    def trips(self) -> DataFrame:
        return stage(trip_patterns(self.signatures, self._trips))
