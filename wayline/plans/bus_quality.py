"""Read-only checks of a published bus network: counts, problems, relationships and the pattern layer."""

from pyspark.sql import Column, DataFrame, functions as F

from wayline.operators import constraints as c
from wayline.operators.ordered import previous


def measures(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Several aggregates of one table in a single scan, one row per name."""
    wide = df.agg(*[x.cast("bigint").alias(f"c{i}") for i, x in enumerate(named.values())])
    rows = F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(f"c{i}").alias("n")) for i, k in enumerate(named)])
    return wide.select(F.explode(rows).alias("r")).select("r.check_name", "r.n")


def flags(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    return measures(df, {k: F.count(F.when(x, 1)) for k, x in checks.items()})


def times_backwards(stop_times: DataFrame) -> DataFrame:
    """Trips that arrive somewhere before they left the stop before it."""
    return c.falling(stop_times, "trip_id", "stop_sequence", "arrival_s", since="departure_s").select("trip_id").distinct()


def pattern_steps(pattern_stop: DataFrame) -> DataFrame:
    """Offset and sequence of the stop before, per pattern position."""
    d = previous(pattern_stop, ["pattern_id"], "idx", F.struct("offset_s", "stop_sequence"), "before")
    return d.select("pattern_id", "idx", "offset_s", "stop_sequence", F.col("before.offset_s").alias("prev_offset"),
                    F.col("before.stop_sequence").alias("prev_sequence"))


def in_india(lat: Column, lon: Column) -> Column:
    return lat.between(6, 38) & lon.between(68, 98)


def pattern_report(pattern: DataFrame, pattern_stop: DataFrame, trip_pattern: DataFrame) -> DataFrame:
    """What the pattern layer promises, counted where it is broken: keys, references, a dense index, rising values."""
    return c.violations({
        "pattern key (route_id, signature) repeated": c.not_unique(pattern, "route_id", "signature"),
        "pattern without two stops": pattern.filter("stop_count < 2"),
        "pattern.stop_count is not the number of its stops": c.child_count(pattern, pattern_stop, "pattern_id",
                                                                           F.col("children") == F.col("stop_count")),
        "pattern_stop.idx has gaps": c.gaps(pattern_stop, "pattern_id", "idx"),
        "pattern_stop.offset_s falls": c.falling(pattern_stop, "pattern_id", "idx", "offset_s"),
        "pattern_stop.stop_sequence does not rise": c.falling(pattern_stop, "pattern_id", "idx", "stop_sequence", strict=True),
        "trip.pattern_id names no row": c.dangling(trip_pattern, pattern, "pattern_id"),
        "trip.route_id is not that of its pattern": c.disagreeing(trip_pattern, pattern, "pattern_id", "route_id"),
    })
