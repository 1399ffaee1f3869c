"""Metro feed: station clustering, line patterns, service graph, logical lines and path reconstruction."""

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayline.functions import scalars as s, text as tx
from wayline.functions.geo import EARTH_METRO, cell, haversine
from wayline.operators.accept import accepted, judge, reasons
from wayline.operators.components import components
from wayline.operators.ordered import position, previous
from wayline.operators.stage import stage
from wayline.plans.bus_feed import REGION, bad_position, known, outside

# Fixed values.
CLUSTER_METERS = 300.0
MAX_GAP_METERS = 40_000.0
NOTE = r"\s*\([^()]*\)\s*$"


def has_note(name: Column) -> Column:
    return name.rlike(NOTE)


def base_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, NOTE, "")), r"\s+", " "))


def stops(raw: DataFrame, region=REGION) -> DataFrame:
    kind = F.when(tx.blank(F.col("location_type")), 0).otherwise(s.whole(F.col("location_type")))
    d = (raw.withColumn("kind", kind).withColumn("name", tx.display(F.col("stop_name"))).withColumn("lat", F.col("stop_lat").try_cast("double"))
         .withColumn("lon", F.col("stop_lon").try_cast("double")))
    lat, lon = F.col("lat"), F.col("lon")
    d = judge(d, ["stop_id"], "row_pos",
              reasons((F.col("kind").isNull(), "invalid location type"), (tx.no_text(F.col("stop_name")), "station without a name"),
                      (bad_position(lat, lon), "invalid coordinates"), (outside(lat, lon, region), "coordinates outside the supported region")),
              reasons((tx.blank(F.col("stop_id")), "stop without an id")), F.coalesce(F.col("kind") >= 2, F.lit(False)), skip_blocks=True)
    return d.withColumn("lat", s.round6(lat)).withColumn("lon", s.round6(lon))


def routes(raw: DataFrame) -> DataFrame:
    long, short = tx.display(F.col("route_long_name")), tx.display(F.col("route_short_name"))
    d = raw.withColumn("name", F.when(long != "", long).otherwise(short)).withColumn("short", short)
    d = judge(d, ["route_id"], "row_pos",
              reasons((tx.no_text(F.col("route_long_name")) & tx.no_text(F.col("route_short_name")), "route without a name")),
              reasons((tx.blank(F.col("route_id")), "route without an id")))
    return (d.withColumn("short_name", F.when((F.col("short") != "") & (F.col("short") != F.col("name")), F.col("short")))
            .withColumn("color", s.color(F.col("route_color"))).drop("short"))


def trips(raw: DataFrame, route_ids: DataFrame) -> DataFrame:
    d = known(raw, route_ids, "route_id", "has_route")
    return judge(d, ["trip_id"], "row_pos", reasons((~F.col("has_route"), "trip of an unknown route")),
                 reasons((tx.blank(F.col("trip_id")), "trip without an id"))).drop("has_route")


def stop_times(raw: DataFrame, trip_ids: DataFrame, stop_ids: DataFrame, skipped: DataFrame) -> DataFrame:
    d = raw.withColumn("seq", s.whole(F.col("stop_sequence")))
    d = known(d, trip_ids, "trip_id", "has_trip")
    d = known(d, stop_ids, "stop_id", "has_stop")
    d = stage(known(d, skipped, "stop_id", "silent"))
    return judge(d, ["trip_id", "seq"], "row_pos",
                 reasons((~F.col("has_stop"), "stop time of an unknown stop"), (F.coalesce(F.col("seq"), F.lit(-1)) < 0, "invalid stop sequence")),
                 reasons((~F.col("has_trip"), "stop time of an unknown trip")), F.col("silent") & F.col("has_trip"),
                 late_duplicate=True).drop("has_trip", "has_stop", "silent")


# ---- stations

def cluster_links(stop: DataFrame) -> DataFrame:
    """Pairs of stops that are one station: a stated parent, or the same name written twice close by.

    Equal spellings at one position are tied to one representative, so a name repeated a million times at a place adds a
    million links, not all its pairs; only the representatives of neighbouring cells are compared with each other.
    """
    parents = (stop.filter("trim(parent_station) <> ''").select(F.col("stop_id").alias("a"), F.col("parent_station").alias("b"))
               .join(stop.select(F.col("stop_id").alias("b")), "b", "left_semi").select("a", "b"))
    d = stop.select("stop_id", F.lower("name").alias("full"), base_key(F.col("name")).alias("base"), has_note(F.col("name")).alias("note"), "lat", "lon")
    place = ["base", "full", "note", "lat", "lon"]
    reps = stage(d.groupBy(*place).agg(F.min("stop_id").alias("rep")))
    same = d.join(reps, place).filter("stop_id <> rep").select(F.col("stop_id").alias("a"), F.col("rep").alias("b"))
    size = CLUSTER_METERS / 111_320.0
    wide = size / 0.5  # a cell of longitude that covers the radius up to latitude 60
    r = reps.withColumn("cy", cell(F.col("lat"), size)).withColumn("cx", cell(F.col("lon"), wide))
    near = r.select("base", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("cy"), "cx", F.col("full").alias("full2"),
                    F.col("note").alias("note2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("rep").alias("b"))
    near = near.withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)))
    hit = (r.join(near, ["base", "cy", "cx"]).filter(F.col("rep") < F.col("b")).filter((F.col("full") == F.col("full2")) | (F.col("note") != F.col("note2")))
           .filter(haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), EARTH_METRO) <= CLUSTER_METERS))
    return parents.unionByName(same).unionByName(hit.select(F.col("rep").alias("a"), "b"))


def stations(stop: DataFrame) -> DataFrame:
    """stop -> station key, the smallest stop id of its cluster."""
    ids = stop.select(F.col("stop_id").alias("id"))
    return components(ids, cluster_links(stop)).select(F.col("id").alias("stop_id"), F.col("component").alias("station"))


def station_records(stop: DataFrame, member: DataFrame) -> DataFrame:
    """Name, position, member ids and access statement of each station."""
    d = stop.join(member, "stop_id")
    parent = F.col("kind") == 1
    one = F.struct("stop_id", "name", "lat", "lon", s.access_status(F.col("wheelchair_boarding")).alias("access"))
    per = d.groupBy("station").agg(
        F.min(F.when(parent, one)).alias("p"), F.min(F.when(~has_note(F.col("name")), one)).alias("plain"), F.min(one).alias("any"),
        F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"), F.count(F.lit(1)).alias("stop_count"), F.count(F.when(~parent, 1)).alias("children"))
    ids = d.groupBy("station").agg(F.array_join(F.array_sort(F.collect_list("stop_id")), ",").alias("stop_ids"))
    own = s.access_status(F.col("wheelchair_boarding"))
    child = (d.filter(~parent).join(per.select("station", F.coalesce("p.access", F.lit("UNKNOWN")).alias("inherited")), "station")
             .withColumn("eff", F.when(own == "UNKNOWN", F.col("inherited")).otherwise(own)).groupBy("station")
             .agg(F.when(F.min("eff") == F.max("eff"), F.min("eff")).otherwise("UNKNOWN").alias("combined")))
    main = F.coalesce("p", "plain", "any")
    return (per.join(ids, "station").join(child, "station", "left").select(
        "station", main["name"].alias("name"), s.round6(F.coalesce(F.col("p.lat"), F.col("mlat"))).alias("lat"),
        s.round6(F.coalesce(F.col("p.lon"), F.col("mlon"))).alias("lon"), "stop_ids", "stop_count",
        F.coalesce("combined", F.col("p.access"), F.lit("UNKNOWN")).alias("wheelchair")))


def trip_stations(times: DataFrame, member: DataFrame) -> DataFrame:
    """Stations of each trip in order, without consecutive repeats, with the station before."""
    d = times.select("trip_id", "seq", "stop_id").join(member, "stop_id").select("trip_id", "seq", "station")
    d = previous(d, ["trip_id"], "seq", F.col("station"), "before")
    return d.filter(F.col("before").isNull() | (F.col("before") != F.col("station")))


def trip_results(calls: DataFrame, trip_ids: DataFrame, first_member: DataFrame) -> DataFrame:
    """Two stations at least, and none implausibly far from the one before."""
    a = first_member.select("station", "lat", "lon")
    b = first_member.select(F.col("station").alias("before"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    d = calls.join(a, "station").join(b, "before", "left")
    far = haversine(F.col("blat"), F.col("blon"), F.col("lat"), F.col("lon"), EARTH_METRO) > MAX_GAP_METERS
    per = d.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(far, F.lit(False))).alias("far"))
    return (trip_ids.select("trip_id", "route_id").join(per, "trip_id", "left")
            .select("trip_id", "route_id", F.coalesce("n", F.lit(0)).alias("stations"),
                    reasons((F.col("n").isNull(), "trip without stop times"), (F.col("n") < 2, "trip with fewer than two stations"),
                            (F.col("far"), "trip with an implausible distance between stations")).alias("reason")))


def connections(calls: DataFrame, valid: DataFrame) -> DataFrame:
    """Directed station pairs of each line with their number of trips."""
    d = calls.filter("before is not null").join(valid.select("trip_id", "route_id"), "trip_id")
    return d.groupBy("route_id", F.col("before").alias("from_station"), F.col("station").alias("to_station")).agg(F.count(F.lit(1)).alias("trips"))


def line_patterns(calls: DataFrame, valid: DataFrame) -> DataFrame:
    """Distinct station sequences per line in one orientation, without those contained in a longer one; numbered by length."""
    seqs = (calls.join(valid.select("trip_id", "route_id"), "trip_id").groupBy("trip_id", "route_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "station"))), lambda x: x["station"]).alias("list")))
    fwd, back = F.array_join("list", "|"), F.array_join(F.reverse("list"), "|")
    p = stage(seqs.select("route_id", F.least(fwd, back).alias("key"), F.size("list").alias("n")).distinct())
    # A contained sequence shares its first step with the longer one, in one direction or the other.
    step = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.concat(F.element_at(x, i), F.lit("|"), F.element_at(x, i + 1)))
    longer = p.withColumn("l", F.split("key", r"\|")).select("route_id", F.col("key").alias("long_key"), F.col("n").alias("long_n"),
                                                             F.explode(F.array_distinct(F.concat(step(F.col("l")), step(F.reverse("l"))))).alias("step"))
    short = p.withColumn("l", F.split("key", r"\|")).withColumn("step", F.concat(F.get("l", F.lit(0)), F.lit("|"), F.get("l", F.lit(1))))
    bar = lambda c: F.concat(F.lit("|"), c, F.lit("|"))
    inside = F.contains(bar(F.col("long_key")), bar(F.col("key"))) | F.contains(bar(F.array_join(F.reverse(F.split("long_key", r"\|")), "|")), bar(F.col("key")))
    lost = short.join(longer, ["route_id", "step"]).filter(F.col("long_n") > F.col("n")).filter(inside).select("route_id", "key").distinct()
    order = W.partitionBy("route_id").orderBy(F.desc("n"), "key")
    return p.join(lost, ["route_id", "key"], "left_anti").withColumn("number", F.row_number().over(order))


def station_lines(patterns: DataFrame) -> DataFrame:
    return patterns.select("route_id", "number", F.posexplode(F.split("key", r"\|")).alias("i", "station")).select(
        "route_id", "number", "station", (F.col("i") + 1).alias("sequence"))


def undirected(conn: DataFrame) -> DataFrame:
    return conn.select("route_id", F.least("from_station", "to_station").alias("a"), F.greatest("from_station", "to_station").alias("b")).distinct()


def logical_lines(routes: DataFrame, conn: DataFrame) -> DataFrame:
    """Services of one colour that share a stretch of track, by the first service seen on each stretch."""
    e = undirected(conn).filter("a <> b")
    c = routes.select("route_id", "color")
    first = e.groupBy("a", "b").agg(F.min("route_id").alias("owner"))
    links = (e.join(first, ["a", "b"]).filter("owner <> route_id").select("route_id", "owner").distinct().join(c, "route_id")
             .join(c.select(F.col("route_id").alias("owner"), F.col("color").alias("owner_color")), "owner").filter("color = owner_color"))
    ids = routes.select(F.col("route_id").alias("id"))
    comp = components(ids, links.select(F.col("owner").alias("a"), F.col("route_id").alias("b")))
    d = comp.select(F.col("id").alias("route_id"), F.col("component").alias("group_id")).join(routes.select("route_id", "name"), "route_id")
    d = d.withColumn("base", tx.base_name(F.col("name")))
    n = d.groupBy("group_id", "base").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("group_id").agg(F.min(F.struct((-F.col("n")).alias("o"), "base")).alias("m")).select("group_id", F.col("m.base").alias("group_name"))
    return d.join(best, "group_id").select("route_id", "group_id", "group_name", tx.branch_of(F.col("name")).alias("branch_name"))


def line_counts(links: DataFrame, groups: DataFrame) -> DataFrame:
    """Services and logical lines per station; two logical lines make an interchange."""
    return (links.select("station", "route_id").distinct().join(groups.select("route_id", "group_id"), "route_id").groupBy("station")
            .agg(F.count(F.lit(1)).alias("services"), F.countDistinct("group_id").alias("lines")).withColumn("interchange", F.col("lines") >= 2))


# ---- path reconstruction

def reconstruct(rides: DataFrame, conn: DataFrame) -> DataFrame:
    """The one station path of exactly ``hops`` steps from board to exit, per ride; nothing when there are several.

    Rides between the same ends of the same length ask once. Paths grow by a join per step from the boarding side; a branch survives only where
    the exit is still reachable in the steps left, found by expanding the exits backwards as plain (exit, station, steps) facts that all who ask
    for an exit share. A step meets only the facts with its number of steps left.
    """
    e = undirected(conn)
    adj = stage(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    asked = stage(rides.select("board", "exit", "hops").distinct())
    longest = asked.agg(F.max("hops")).first()[0] or 0
    reach = [asked.groupBy(F.col("exit").alias("goal")).agg(F.max("hops").alias("most")).withColumn("at", F.col("goal"))]
    for k in range(1, longest):
        step = reach[-1].filter(F.col("most") > k).join(adj, F.col("at") == F.col("b")).select("goal", "most", F.col("a").alias("at")).distinct()
        reach.append(stage(step))
    can = stage(reduce(DataFrame.unionByName, [r.select("goal", "at", F.lit(k).cast("bigint").alias("left")) for k, r in enumerate(reach)]))
    paths = asked.withColumn("at", F.col("board")).withColumn("path", F.array("board"))
    done = [paths.filter("hops = 0")]
    for k in range(1, longest + 1):
        grown = (paths.filter(F.col("hops") >= k).join(adj, F.col("at") == F.col("a")).filter(~F.array_contains("path", F.col("b")))
                 .select("board", "exit", "hops", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"), (F.col("hops") - k).alias("left")))
        paths = stage(grown.join(can.withColumnRenamed("goal", "exit"), ["exit", "at", "left"], "left_semi").drop("left"))
        done.append(paths.filter(F.col("hops") == k))
    every = reduce(DataFrame.unionByName, done)
    found = every.groupBy("board", "exit", "hops").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    # A ride is between null ends, or has no id, only if it goes nowhere.
    same = F.col("r.board").eqNullSafe(F.col("p.board")) & F.col("r.exit").eqNullSafe(F.col("p.exit")) & (F.col("r.hops") == F.col("p.hops"))
    per = rides.filter("ride_id is not null or hops = 0").alias("r").join(found.alias("p"), same).select("ride_id", "n", "path")
    return per.groupBy("ride_id").agg(F.sum("n").alias("n"), F.min("path").alias("path")).filter("n = 1").drop("n")


def services_on_path(paths: DataFrame, conn: DataFrame) -> DataFrame:
    """Services that run along every step of a path. A path that many rides take is looked at once."""
    of = stage(paths.filter("ride_id is not null and size(path) > 1").select("ride_id", "path"))
    step = lambda i: F.struct(i.alias("i"), F.least(F.get("path", i - 1), F.get("path", i)).alias("a"), F.greatest(F.get("path", i - 1), F.get("path", i)).alias("b"))
    steps = of.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), step)).alias("s")).select("path", "s.*")
    on = steps.join(undirected(conn), ["a", "b"]).groupBy("path", "route_id").agg(F.countDistinct("i").alias("n")).filter("n = size(path) - 1")
    return of.join(on, "path").select("ride_id", "route_id").distinct()


class Import:
    """One metro feed; tables that later steps read again are staged on first use."""

    def __init__(self, stop, route, trip, stop_time):
        self.stops = stops(stop)
        self.routes = routes(route)
        self._trip, self._time = trip, stop_time

    @cached_property
    def stop(self):
        return stage(accepted(self.stops))

    @cached_property
    def trips(self):
        return stage(trips(self._trip, accepted(self.routes).select("route_id")))

    @cached_property
    def times(self):
        skipped = self.stops.filter("outcome = 'skipped'").select("stop_id")
        return stage(stop_times(self._time, accepted(self.trips).select("trip_id"), self.stop.select("stop_id"), skipped))

    @cached_property
    def member(self):
        return stage(stations(self.stop))

    @cached_property
    def calls(self):
        return stage(trip_stations(accepted(self.times), self.member))

    @cached_property
    def results(self):
        first = self.stop.join(self.member, "stop_id").groupBy("station").agg(F.min_by(F.struct("lat", "lon"), "row_pos").alias("f")).select(
            "station", "f.lat", "f.lon")
        return stage(trip_results(self.calls, accepted(self.trips), first))

    @property
    def valid(self):
        return self.results.filter("reason is null")

    @cached_property
    def connections(self):
        return stage(connections(self.calls, self.valid))

    @cached_property
    def patterns(self):
        return stage(line_patterns(self.calls, self.valid))

    @cached_property
    def lines(self):
        return stage(accepted(self.routes).join(self.valid.select("route_id"), "route_id", "left_semi"))

    @cached_property
    def groups(self):
        return stage(logical_lines(self.lines, self.connections))
