"""Service days, active patterns and next departures."""

from pyspark.sql import DataFrame, functions as F

from wayline.functions.scalars import weekday_name

DAY = 86_400
MAX_WAIT = 90 * 60


def last_exceptions(raw: DataFrame, services: DataFrame) -> DataFrame:
    return (raw.join(services.select("d", "service_id"), "d").groupBy("service_id", F.col("service_date").alias("day"))
            .agg(F.max_by("added", "row_pos").alias("added")))


def services_on(days: DataFrame, services: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(day, service) pairs that run: weekday in period and not removed, or added.

    Periods are unrolled to dates and met with the wanted days by equality, so no day is compared with every service.
    """
    regular = (services.withColumn("day", F.explode(F.sequence("start_date", "end_date"))).join(days, "day", "left_semi")
               .filter(F.array_contains(F.split("days", ","), weekday_name(F.col("day")))).select("day", "service_id"))
    removed = exceptions.filter("not added").select("day", "service_id")
    added = exceptions.filter("added").join(days, "day", "left_semi").select("day", "service_id")
    return regular.join(removed, ["day", "service_id"], "left_anti").unionByName(added).distinct()


def active_patterns(running: DataFrame, trip_pattern: DataFrame) -> DataFrame:
    """(day, pattern) with at least one trip of a running service."""
    served = trip_pattern.filter("pattern_id is not null").select("service_id", "pattern_id").distinct()
    return running.join(served, "service_id").select("day", "pattern_id").distinct()


def departures(positions: DataFrame, trip_pattern: DataFrame) -> DataFrame:
    """Every scheduled call at a pattern position, with the time a rider can board."""
    t = trip_pattern.filter("pattern_id is not null").select("trip_id", "pattern_id", "service_id")
    return (positions.withColumn("board_s", F.coalesce("departure_s", "arrival_s")).filter("board_s is not null")
            .select("trip_id", F.col("idx").alias("board_idx"), "board_s").join(t, "trip_id"))


def next_departure(wanted: DataFrame, key: list[str], calls: DataFrame, running: DataFrame) -> DataFrame:
    """First departure at or after ``ready_s`` for each wanted (day, pattern_id, board_idx), waiting at most 90 minutes.

    Today's trips and yesterday's past-midnight trips compete. Times are cut into buckets as wide as the longest
    wait, so a request meets only the calls of two buckets of either day instead of the whole day. Only the calls it meets are
    asked for their service days: calls are not copied to all days on which they run.
    """
    runs = calls.select("pattern_id", "board_idx", F.floor(F.col("board_s") / MAX_WAIT).alias("bucket"), "board_s", "trip_id", "service_id")
    probe = wanted.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(-DAY)))).withColumn("from_s", F.col("ready_s") - F.col("shift"))
    first = F.floor(F.col("from_s") / MAX_WAIT)
    probe = probe.withColumn("bucket", F.explode(F.array(first, first + 1)))
    hit = (probe.join(runs, ["pattern_id", "board_idx", "bucket"])
           .filter((F.col("board_s") >= F.col("from_s")) & (F.col("board_s") - F.col("from_s") <= MAX_WAIT))
           .withColumn("eff_s", F.col("board_s") + F.col("shift"))
           .withColumn("run_day", F.when(F.col("shift") == 0, F.col("day")).otherwise(F.date_sub("day", 1)))
           .join(running.select(F.col("day").alias("run_day"), "service_id"), ["run_day", "service_id"]))
    return (hit.groupBy(*key).agg(F.min(F.struct("eff_s", "trip_id", "shift")).alias("run"))
            .select(*key, F.col("run.eff_s").alias("board_s"), "run.trip_id", "run.shift"))
