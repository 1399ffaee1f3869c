"""Bus feed import: every row of the eight feed tables is accepted, skipped, a duplicate or rejected with a reason.

Inputs are all-text tables with a sortable ``row_pos`` (the position in the file).
"""

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayline.functions import scalars as s, text as tx
from wayline.operators.accept import acceptable, accepted, accepted_keys, judge, reasons, tally
from wayline.operators.ordered import WIDTH, previous
from wayline.operators.stage import stage

REGION = (6.0, 38.0, 68.0, 98.0)  # latitude and longitude limits of the supported region
FILE_CHUNK = 1 << 20
LAST = (1 << 63) - 1


def outside(lat: Column, lon: Column, region=REGION) -> Column:
    return ~(lat.between(region[0], region[1]) & lon.between(region[2], region[3]))


def bad_position(lat: Column, lon: Column) -> Column:
    ok = s.finite(lat) & s.finite(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return ~F.coalesce(ok, F.lit(False))


def known(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """Adds a boolean: is the key among the ids?"""
    return (df.join(ids.select(key).distinct().withColumn(flag, F.lit(True)), key, "left")
            .withColumn(flag, F.coalesce(flag, F.lit(False))))


def agencies(raw: DataFrame) -> DataFrame:
    d = raw.withColumn("name", tx.display(F.col("agency_name")))
    return judge(d, ["agency_id"], "row_pos", F.lit(None).cast("string"),
                 reasons((tx.blank(F.col("agency_id")) | tx.no_text(F.col("agency_name")), "agency without an id or name")))


def _stop_rules(raw: DataFrame, region) -> tuple:
    d = (raw.withColumn("name", tx.display(F.col("stop_name"))).withColumn("lat", F.col("stop_lat").try_cast("double"))
         .withColumn("lon", F.col("stop_lon").try_cast("double")))
    lat, lon = F.col("lat"), F.col("lon")
    kind = F.col("location_type")
    return (d, ["stop_id"], "row_pos",
            reasons((tx.no_text(F.col("stop_name")), "stop without a name"), (bad_position(lat, lon), "invalid coordinates"),
                    (outside(lat, lon, region), "coordinates outside the supported region")),
            reasons((tx.blank(F.col("stop_id")), "stop without an id")), ~tx.blank(kind) & (kind != "0"))


def stops(raw: DataFrame, region=REGION) -> DataFrame:
    d = judge(*_stop_rules(raw, region))
    return (d.withColumn("lat", s.round6(F.col("lat"))).withColumn("lon", s.round6(F.col("lon")))
            .withColumn("access", s.access_status(F.col("wheelchair_boarding"))))


def stop_ids(raw: DataFrame, region=REGION) -> DataFrame:
    """The ids of the accepted stops."""
    return accepted_keys(*_stop_rules(raw, region))


def routes(raw: DataFrame, agency_ids: DataFrame, check_agency: bool = True) -> DataFrame:
    d = (raw.withColumn("long_name", tx.display(F.col("route_long_name")))
         .withColumn("short_name", tx.display(F.col("route_short_name"))).withColumn("kind", s.whole(F.col("route_type"))))
    d = known(d, agency_ids, "agency_id", "has_agency")
    d = judge(d, ["route_id"], "row_pos",
              reasons((tx.no_text(F.col("route_long_name")) & tx.no_text(F.col("route_short_name")), "route without a name"),
                      (F.lit(check_agency) & ~tx.blank(F.col("agency_id")) & ~F.col("has_agency"), "route of an unknown agency"),
                      (F.coalesce(F.col("kind"), F.lit(-1)) < 0, "invalid route type")),
              reasons((tx.blank(F.col("route_id")), "route without an id")))
    return d.withColumn("color", s.color(F.col("route_color"))).drop("has_agency")


def calendar(raw: DataFrame) -> DataFrame:
    d = raw.withColumn("start_day", s.basic_date(F.col("start_date"))).withColumn("end_day", s.basic_date(F.col("end_date")))
    flags = reduce(lambda a, b: a | b, [~F.col(x).isin("0", "1") for x in s.DAYS])
    d = judge(d, ["service_id"], "row_pos",
              reasons((F.col("start_day").isNull() | F.col("end_day").isNull(), "invalid service dates"),
                      (F.col("end_day") < F.col("start_day"), "service ends before it starts"),
                      (flags, "invalid service day flag")),
              reasons((tx.blank(F.col("service_id")), "service without an id")))
    return d.withColumn("days", s.day_list({x: F.col(x) for x in s.DAYS}))


def calendar_dates(raw: DataFrame) -> DataFrame:
    """Repeats are legal here (the last one applies), so nothing is a duplicate."""
    day, kind = s.basic_date(F.col("date")), F.col("exception_type")
    bad = day.isNull() | tx.blank(F.col("service_id")) | ~kind.isin("1", "2")
    return (raw.withColumn("service_date", day).withColumn("added", kind == "1")
            .withColumn("reason", reasons((bad, "invalid calendar date entry")))
            .withColumn("outcome", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")))


def service_exceptions(dates: DataFrame, services: DataFrame) -> DataFrame:
    """The last exception per service and date, for services that have a calendar row."""
    return (dates.join(services.select("service_id").distinct(), "service_id", "left_semi")
            .groupBy("service_id", "service_date").agg(F.max_by("added", "row_pos").alias("added")))


def _point_rules(raw: DataFrame, region) -> tuple:
    d = (raw.withColumn("lat", F.col("shape_pt_lat").try_cast("double")).withColumn("lon", F.col("shape_pt_lon").try_cast("double"))
         .withColumn("seq", s.whole(F.col("shape_pt_sequence"))))
    lat, lon = F.col("lat"), F.col("lon")
    bad = ~(s.finite(lat) & s.finite(lon)) | F.coalesce(F.col("seq") < 0, F.lit(True)) | outside(lat, lon, region)
    return (d, ["shape_id", "seq"], "row_pos", reasons((bad, "invalid shape point")),
            reasons((tx.blank(F.col("shape_id")), "shape point without a shape id")))


def shape_points(raw: DataFrame, region=REGION) -> DataFrame:
    d = judge(*_point_rules(raw, region), late_duplicate=True)
    return d.withColumn("lat", s.round6(F.col("lat"))).withColumn("lon", s.round6(F.col("lon")))


def shapes(raw: DataFrame, region=REGION) -> DataFrame:
    """Per shape with any usable point: its number of distinct consecutive points and whether it is a line.

    Points equal to the one just before them count once. The first acceptable point of each place and the one before it are found where the
    points of one stretch of a shape are; only a row per stretch travels on to the shape.
    """
    here = F.struct(s.round6(F.col("lat")).alias("lat"), s.round6(F.col("lon")).alias("lon"))
    d = acceptable(*_point_rules(raw, region)).select("shape_id", F.floor(F.col("seq") / F.lit(WIDTH)).cast("bigint").alias("stretch"), "seq", "row_pos", here.alias("at"))
    d = d.repartition("shape_id", "stretch").groupBy("shape_id", "stretch", "seq").agg(F.min_by("at", F.coalesce("row_pos", F.lit(LAST))).alias("at"))
    same = lambda a, b: F.coalesce((F.col(f"{a}.lat") == F.col(f"{b}.lat")) & (F.col(f"{a}.lon") == F.col(f"{b}.lon")), F.lit(False)).cast("int")
    d = d.withColumn("before", F.lag("at").over(W.partitionBy("shape_id", "stretch").orderBy("seq")))
    per = d.groupBy("shape_id", "stretch").agg(F.sum(1 - same("before", "at")).alias("n"), F.min_by("at", "seq").alias("first"), F.max_by("at", "seq").alias("last"))
    per = per.withColumn("before", F.lag("last").over(W.partitionBy("shape_id").orderBy("stretch")))
    return (per.groupBy("shape_id").agg(F.sum(F.col("n") - same("before", "first")).alias("points"))
            .withColumn("reason", reasons((F.col("points") < 2, "shape with fewer than two points")))
            .withColumn("outcome", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")))


def trips(raw: DataFrame, route_ids: DataFrame, service_ids: DataFrame, shape_ids: DataFrame,
          check_service: bool = True) -> DataFrame:
    d = known(raw, route_ids, "route_id", "has_route")
    d = known(d, service_ids, "service_id", "has_service")
    d = stage(known(d, shape_ids, "shape_id", "has_shape"))
    d = judge(d, ["trip_id"], "row_pos",
              reasons((~F.col("has_route"), "trip of an unknown route"), (tx.blank(F.col("service_id")), "trip without a service"),
                      (F.lit(check_service) & ~F.col("has_service"), "trip of an unknown service")),
              reasons((tx.blank(F.col("trip_id")), "trip without an id")))
    return (d.withColumn("headsign", tx.blank_to_null(tx.display(F.col("trip_headsign"))))
            .withColumn("direction", s.direction(F.col("direction_id")))
            .withColumn("shape_cleared", ~tx.blank(F.col("shape_id")) & ~F.col("has_shape"))
            .withColumn("shape", F.when(F.col("has_shape") & ~tx.blank(F.col("shape_id")), F.col("shape_id")))
            .drop("has_route", "has_service", "has_shape"))


def trip_runs(rows: DataFrame) -> DataFrame:
    """Where each trip starts in the file, and where it starts again (NULL when its rows are together)."""
    d = previous(rows.select("trip_id", "row_pos"), [], "row_pos", F.col("trip_id"), "before", FILE_CHUNK)
    starts = stage(d.filter(F.col("before").isNull() | (F.col("before") != F.col("trip_id"))).select("trip_id", "row_pos"))
    first = starts.groupBy("trip_id").agg(F.min("row_pos").alias("first_pos"))
    again = (starts.join(first, "trip_id").filter("row_pos > first_pos").groupBy("trip_id")
             .agg(F.min("row_pos").alias("again_pos"), F.count(F.lit(1)).alias("reappearances")))
    return first.join(again, "trip_id", "left")


def stop_times(raw: DataFrame, trip_ids: DataFrame, stop_ids: DataFrame) -> DataFrame:
    """Row rules. Rows of a trip that reappears later are 'ignored'; the reappearance itself is counted per trip.

    Texts that are parsed here travel no further, and what is asked of a trip is asked in one shuffle.
    """
    d = (raw.withColumn("seq", s.whole(F.col("stop_sequence"))).withColumn("arrival_s", s.gtfs_seconds(F.col("arrival_time")))
         .withColumn("departure_s", s.gtfs_seconds(F.col("departure_time")))
         .withColumn("malformed", s.gtfs_malformed(F.col("arrival_time")) | s.gtfs_malformed(F.col("departure_time")))
         .drop("stop_sequence", "arrival_time", "departure_time"))
    d = known(d, stop_ids, "stop_id", "has_stop")
    d = known(d, trip_ids, "trip_id", "has_trip")
    again = trip_runs(raw).filter("again_pos is not null").select("trip_id", "again_pos")
    d = stage(d.join(again, "trip_id", "left"))
    late = F.col("has_trip") & F.coalesce(F.col("row_pos") >= F.col("again_pos"), F.lit(False))
    why = reasons((late, "ignored"), (~F.col("has_stop"), "stop time of an unknown stop"),
                  (F.coalesce(F.col("seq"), F.lit(-1)) < 0, "invalid stop sequence"), (F.col("malformed"), "malformed stop time"),
                  (F.col("departure_s") < F.col("arrival_s"), "departure before arrival"))
    d = judge(d, ["trip_id", "seq"], "row_pos", why, reasons((~F.col("has_trip"), "stop time of an unknown trip")),
              late_duplicate=True)
    ignored = F.coalesce(F.col("reason") == "ignored", F.lit(False))
    return (d.withColumn("outcome", F.when(ignored, "ignored").otherwise(F.col("outcome")))
            .withColumn("reason", F.when(~ignored, F.col("reason"))).drop("has_trip", "has_stop", "again_pos", "malformed"))


def trip_results(rows: DataFrame, trip_ids: DataFrame) -> DataFrame:
    """Trip rules over the judged stop times: two valid rows at least, and times that never go back.

    Rows are counted and compared where those of one stretch of a trip are; only a row per stretch travels on to the trip.
    """
    ok = F.col("outcome") == "accepted"
    d = (rows.filter("outcome <> 'ignored'")
         .select("trip_id", F.floor(F.col("seq") / F.lit(WIDTH)).cast("bigint").alias("stretch"), "seq", ok.alias("ok"),
                 F.when(ok, F.coalesce("arrival_s", "departure_s")).alias("here"), F.when(ok, F.coalesce("departure_s", "arrival_s")).alias("left")))
    earlier = W.partitionBy("trip_id", "stretch").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("before", F.last("left", ignorenulls=True).over(earlier))
    timed = F.when(F.col("here").isNotNull(), F.col("seq"))
    per = d.groupBy("trip_id", "stretch").agg(F.count(F.when(F.col("ok"), 1)).alias("n"), F.bool_or(F.coalesce(F.col("here") < F.col("before"), F.lit(False))).alias("back"),
                                              F.min_by("here", timed).alias("first"), F.max_by("left", timed).alias("last"))
    earlier = W.partitionBy("trip_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("before", F.last("last", ignorenulls=True).over(earlier))
    per = per.groupBy("trip_id").agg(F.sum("n").alias("rows"), F.bool_or(F.col("back") | F.coalesce(F.col("first") < F.col("before"), F.lit(False))).alias("backwards"))
    n = F.coalesce("rows", F.lit(0))
    return (trip_ids.select("trip_id").join(per, "trip_id", "left")
            .withColumn("reason", reasons((F.col("rows").isNull(), "trip without stop times"),
                                          (n < 2, "trip with fewer than two valid stop times"),
                                          (F.col("backwards"), "trip with times going backwards")))
            .select("trip_id", n.cast("bigint").alias("rows"), "reason",
                    F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("outcome")))


class Import:
    """One feed, judged table by table. Tables that later tables read again are staged on first use."""

    def __init__(self, agency, stop, route, cal, cal_date, shape, trip, stop_time, region=REGION, has_agency: bool = True,
                 has_calendar: bool = True):
        """``has_agency``, ``has_calendar``: whether the feed brings these tables; without them their ids are not checked."""
        self._has_calendar = has_calendar
        self.raw_trip, self.raw_stop_time = trip, stop_time
        self._stop_ids = stop_ids(stop, region)
        self.agencies = agencies(agency)
        self.stops = stops(stop, region)
        self.routes = routes(route, self._ids(self.agencies, "agency_id"), has_agency)
        self.calendar = calendar(cal)
        self.dates = calendar_dates(cal_date)
        self.points = shape_points(shape, region)
        self._raw_shape, self._region = shape, region

    @staticmethod
    def _ids(judged: DataFrame, key: str) -> DataFrame:
        return accepted(judged).select(key)

    @cached_property
    def shapes(self) -> DataFrame:
        return stage(shapes(self._raw_shape, self._region))

    @cached_property
    def trips(self) -> DataFrame:
        services = self._ids(self.calendar, "service_id").unionByName(self._ids(self.dates, "service_id")).distinct()
        return stage(trips(self.raw_trip, self._ids(self.routes, "route_id"), services, self._ids(self.shapes, "shape_id"), self._has_calendar))

    @cached_property
    def stop_times(self) -> DataFrame:
        return stage(stop_times(self.raw_stop_time, self._ids(self.trips, "trip_id"), self._stop_ids))

    @cached_property
    def runs(self) -> DataFrame:
        return trip_runs(self.raw_stop_time)

    @cached_property
    def results(self) -> DataFrame:
        return stage(trip_results(self.stop_times, self._ids(self.trips, "trip_id")))

    def accepted_stop_times(self) -> DataFrame:
        return accepted(self.stop_times).join(accepted(self.results).select("trip_id"), "trip_id", "left_semi")

    def accepted_trips(self) -> DataFrame:
        return accepted(self.trips).join(accepted(self.results).select("trip_id"), "trip_id", "left_semi")

    def statistics(self) -> DataFrame:
        """Rows per table, outcome and reason."""
        parts = [tally(d, n) for n, d in (("agency", self.agencies), ("stops", self.stops), ("routes", self.routes),
                                          ("calendar", self.calendar), ("calendar_dates", self.dates),
                                          ("shape_points", self.points), ("shapes", self.shapes), ("trips", self.trips),
                                          ("stop_times", self.stop_times), ("trip_results", self.results))]
        again = (self.runs.join(accepted(self.trips).select("trip_id"), "trip_id", "left_semi")
                 .agg(F.coalesce(F.sum("reappearances"), F.lit(0)).alias("n"))
                 .select(F.lit("trip_runs").alias("tbl"), F.lit("rejected").alias("outcome"),
                         F.lit("stop times of a trip are not contiguous").alias("reason"), "n"))
        return reduce(DataFrame.unionByName, [*parts, again])

    def usage(self) -> DataFrame:
        """Routes without trips, unused stops, and what the accepted trips carry."""
        ok = accepted(self.trips)
        per = ok.agg(F.count("headsign").alias("trips with headsign"), F.count("direction").alias("trips with direction"),
                     F.count(F.when(F.col("shape").isNull(), 1)).alias("trips without shape"),
                     F.count(F.when(F.col("shape_cleared"), 1)).alias("shape references cleared"))
        flat = per.select(F.explode(F.create_map(*[x for c in per.columns for x in (F.lit(c), F.col(f"`{c}`"))]))
                          .alias("what", "n"))
        count = lambda d, n: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("what"), "n")
        return (flat.unionByName(count(accepted(self.routes).join(ok, "route_id", "left_anti"), "routes without trips"))
                .unionByName(count(accepted(self.stops).join(self.accepted_stop_times(), "stop_id", "left_anti"), "unused stops")))

    def service_period(self) -> DataFrame:
        """First day, last day and weekdays of the services the accepted trip rows use."""
        used = accepted(self.calendar).join(accepted(self.trips), "service_id", "left_semi")
        days = [F.bool_or(F.array_contains("days", d)).alias(d) for d in s.DAYS]
        agg = used.agg(F.min("start_day").alias("first_day"), F.max("end_day").alias("last_day"), *days)
        return agg.select("first_day", "last_day",
                          F.concat_ws(",", *[F.when(F.col(d), d) for d in s.DAYS]).alias("days"))

    def require_usable(self):
        """Refuses a feed that would replace working data with nothing."""
        for name, d in (("stops", self.stops), ("routes", self.routes), ("trips", self.results)):
            if accepted(d).isEmpty():
                raise ValueError(f"The feed has no usable {name}; nothing was imported.")
