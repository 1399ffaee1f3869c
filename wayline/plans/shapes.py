"""Lines drawn on a map: route lines checked and joined, shapes of services, the part of a shape that a ride follows, stations far from a shape."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayline.functions.geo import DEGREE_METERS, EARTH, EARTH_METRO, haversine, point_segment
from wayline.operators.accept import reasons
from wayline.operators.ordered import position, previous, running_sum
from wayline.operators.stage import spread, stage

# Metres between a stop and the shape that passes it, and between a station and the shapes of its services.
STOP_METERS = 300.0
STATION_METERS = 300.0
SRID = 4326
LINES = ["LineString", "MultiLineString"]


# ---- route lines

def normalized_lines(routes: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of each route in one line (``route_id``, ``seq``, ``lat``, ``lon``), and per route why there is none.

    ``routes``: ``route_id``, ``geometry`` (its type), ``srid``. ``points``: ``route_id``, ``part``, ``seq``, ``lat``, ``lon``. Parts are joined in order; a place
    that repeats the one before is left out, also across parts.
    """
    size = points.groupBy("route_id", "part").agg(F.count("*").alias("n"))
    before = running_sum(size, ["route_id"], "part", F.col("n"), "before", inclusive=False).select("route_id", "part", F.coalesce("before", F.lit(0)).alias("before"))
    own = position(points, ["route_id", "part"], "seq", "_at").join(before, ["route_id", "part"])
    line = previous(own.withColumn("_at", F.col("_at") + F.col("before")), ["route_id"], "_at", F.struct("lat", "lon"), "_p")
    line = stage(line.filter(F.col("_p").isNull() | ~(F.col("_p.lat").eqNullSafe(F.col("lat")) & F.col("_p.lon").eqNullSafe(F.col("lon")))).select("route_id", "_at", "lat", "lon"))
    fits = lambda c, most: F.coalesce(~F.isnan(c) & (F.abs(c) <= most), F.lit(False))
    per = line.groupBy("route_id").agg(F.count("*").alias("n"), F.min(fits("lat", 90) & fits("lon", 180)).alias("fits"))
    verdict = routes.join(per, "route_id", "left").select("route_id", reasons(
        (F.col("geometry").isNull() | (F.coalesce("n", F.lit(0)) == 0), "MISSING"), (~F.coalesce("srid", F.lit(0)).isin(0, SRID), "WRONG_SRID"), (~F.col("geometry").isin(LINES), "UNSUPPORTED_TYPE"),
        (~F.col("fits"), "COORDINATE_OUT_OF_RANGE"), (F.col("n") < 2, "NO_LENGTH")).alias("reason"))
    verdict = stage(verdict)
    good = line.join(verdict.filter("reason is null").select("route_id"), "route_id", "left_semi")
    return position(good, ["route_id"], "_at", "seq").select("route_id", "seq", "lat", "lon"), verdict


# ---- shapes of services

def shape_use(trips: DataFrame) -> DataFrame:
    """Per shape (``trips``: ``trip_id``, ``route_id``, ``shape_id``): the route that uses it most (ties: smallest id), its trips, and whether others use it too."""
    used = trips.filter(F.coalesce(F.trim("shape_id"), F.lit("")) != "").groupBy("shape_id", "route_id").agg(F.count("*").alias("n"))
    return used.groupBy("shape_id").agg(F.min(F.struct((-F.col("n")).alias("o"), "route_id")).alias("b"), F.sum("n").alias("trips"), F.count("*").alias("routes")).select(
        "shape_id", F.col("b.route_id").alias("route_id"), "trips", (F.col("routes") > 1).alias("shared"))


def usable_shapes(points: DataFrame) -> DataFrame:
    """Points in order without repeats (``shape_id``, ``seq`` from 0, ``lat``, ``lon``); a shape of fewer than two places is none. Of points with one number the
    first by place in the file (``row_pos``) counts."""
    first = points.groupBy("shape_id", "seq").agg(F.min_by(F.struct("lat", "lon"), "row_pos").alias("p")).select("shape_id", "seq", "p.lat", "p.lon")
    d = previous(first, ["shape_id"], "seq", F.struct("lat", "lon"), "_p")
    d = d.filter(F.col("_p").isNull() | (F.col("_p.lat") != F.col("lat")) | (F.col("_p.lon") != F.col("lon")))
    d = stage(position(d, ["shape_id"], "seq", "_at"))
    several = d.filter("_at = 1").select("shape_id")
    return d.join(spread(several), "shape_id", "left_semi").select("shape_id", F.col("_at").alias("seq"), "lat", "lon")


def service_shapes(use: DataFrame, shapes: DataFrame) -> DataFrame:
    """Shapes of each service in the order in which they are shown: most trips first, then by id (``number`` from 1)."""
    there = shapes.groupBy("shape_id").agg(F.count("*").alias("points"))
    d = use.join(there, "shape_id")
    return d.withColumn("number", F.row_number().over(W.partitionBy("route_id").orderBy(F.desc("trips"), "shape_id"))).select("route_id", "number", "shape_id", "trips", "points", "shared")


def service_period(calendar: DataFrame, used: DataFrame) -> DataFrame:
    """One row: the span of the services that are used and the weekdays on which any of them runs. ``calendar``: ``service_id``, ``start_date``, ``end_date`` (null if
    they cannot be read) and a column per weekday."""
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    d = calendar.join(used.select("service_id").distinct(), "service_id", "left_semi")
    whole = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    per = d.agg(F.min(F.when(whole, F.col("start_date"))).alias("start_date"), F.max(F.when(whole, F.col("end_date"))).alias("end_date"), F.count(F.when(~whole, 1)).alias("unreadable"), *[F.max(F.col(x) == "1").alias(x) for x in days])
    names = F.array_compact(F.array(*[F.when(F.col(x), x) for x in days]))
    return per.select("start_date", "end_date", F.when(F.col("start_date").isNotNull(), F.array_join(names, ",")).alias("days"), "unreadable")


# ---- the part of a shape that a ride follows

CHUNK = 256
_ASK = ["shape_id", "board_lat", "board_lon", "exit_lat", "exit_lon"]


def _cell(c: Column, size: Column | float) -> Column:
    return F.floor(c / size).cast("bigint")


def _passes(stops: DataFrame, shapes: DataFrame, meters: float) -> DataFrame:
    """Vertices of the shape within ``meters`` of a stop (``shape_id``, ``lat``, ``lon``); met in cells, so only the neighbourhood of a stop is looked at."""
    high = meters * 1.001 / DEGREE_METERS
    wide = F.lit(high) / F.cos(F.radians(F.least(F.lit(89.9), F.abs("lat") + high)))
    s = stops.withColumn("cy", F.explode(F.sequence(_cell(F.col("lat") - high, high), _cell(F.col("lat") + high, high))))
    s = s.withColumn("cx", F.explode(F.sequence(_cell(F.col("lon") - wide, high), _cell(F.col("lon") + wide, high))))
    v = shapes.select("shape_id", "seq", F.col("lat").alias("vlat"), F.col("lon").alias("vlon"), _cell(F.col("lat"), high).alias("cy"), _cell(F.col("lon"), high).alias("cx"))
    d = s.join(v, ["shape_id", "cy", "cx"]).withColumn("far", haversine(F.col("lat"), F.col("lon"), F.col("vlat"), F.col("vlon"), EARTH))
    return d.filter(F.col("far") <= meters).select("shape_id", "lat", "lon", "seq", "far")


def slices(rides: DataFrame, shapes: DataFrame, meters: float = STOP_METERS) -> DataFrame:
    """``first`` and ``last`` vertex of the shape for each different ride (``shape_id`` and the places of both stops) that runs past both stops in order.

    The first vertex is the one nearest to the boarding stop, the last one the nearest to the exit from there on (ties: the earlier); each lies
    within ``meters``. Both come from minima over the vertices near a stop: for the exit a running minimum from the end of the shape, read off where
    the ride boards, so a loop that passes a stop twice is cut on the right lap.
    """
    asks = stage(rides.select(*_ASK).distinct().dropna())
    place = lambda s: asks.select("shape_id", F.col(f"{s}_lat").alias("lat"), F.col(f"{s}_lon").alias("lon"))
    near = stage(_passes(place("board").union(place("exit")).distinct(), shapes, meters))
    board = near.groupBy("shape_id", F.col("lat").alias("board_lat"), F.col("lon").alias("board_lon")).agg(F.min(F.struct("far", "seq")).alias("b"))
    asks = asks.join(board, ["shape_id", "board_lat", "board_lon"]).withColumn("first", F.col("b.seq")).drop("b")
    here = ["shape_id", "exit_lat", "exit_lon"]
    wanted = asks.select(*here, F.col("first").alias("seq")).distinct().withColumn("best", F.lit(None).cast("struct<far:double,seq:bigint>")).withColumn("ask", F.lit(1))
    passed = near.select("shape_id", F.col("lat").alias("exit_lat"), F.col("lon").alias("exit_lon"), "seq", F.struct("far", "seq").alias("best"), F.lit(0).alias("ask"))
    on = W.partitionBy(*here).orderBy(F.desc("seq"), "ask").rowsBetween(W.unboundedPreceding, 0)
    later = passed.unionByName(wanted).withColumn("best", F.min("best").over(on)).filter("ask = 1 and best is not null")
    out = asks.join(later.select(*here, F.col("seq").alias("first"), F.col("best.seq").alias("last")), [*here, "first"])
    return out.filter("last > first").select(*_ASK, "first", "last")


def ride_lines(rides: DataFrame, shapes: DataFrame, stops: DataFrame, meters: float = STOP_METERS) -> DataFrame:
    """The line of each ride (``ride_id``, ``pos``, ``lat``, ``lon``, ``source``): boarding stop, the shape between, exit; or, where the shape does not run past both in
    order, the ``stops`` of the ride (``ride_id``, ``pos``, ``lat``, ``lon``). Only the chunks of a shape that a slice touches are read for it."""
    cut = slices(rides, shapes, meters)
    known = stage(rides.join(cut, _ASK, "left"))
    part = known.filter("first is not null").withColumn("chunk", F.explode(F.sequence(F.expr(f"first div {CHUNK}"), F.expr(f"last div {CHUNK}"))))
    v = shapes.withColumn("chunk", F.expr(f"seq div {CHUNK}"))
    inner = part.join(v, ["shape_id", "chunk"]).filter(F.col("seq").between(F.col("first"), F.col("last"))).select("ride_id", (F.col("seq") - F.col("first") + 1).alias("pos"), "lat", "lon")
    ends = known.filter("first is not null").select("ride_id", F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("pos"), F.col("board_lat").alias("lat"), F.col("board_lon").alias("lon")),
        F.struct((F.col("last") - F.col("first") + 2).alias("pos"), F.col("exit_lat").alias("lat"), F.col("exit_lon").alias("lon")))).alias("e")).select("ride_id", "e.*")
    drawn = inner.unionByName(ends).withColumn("source", F.lit("GTFS_SHAPES"))
    rest = stops.join(known.filter("first is null").select("ride_id"), "ride_id", "left_semi").select("ride_id", "pos", "lat", "lon").withColumn("source", F.lit("STOP_SEQUENCE"))
    return drawn.unionByName(rest)


def geometry_source(rides: DataFrame) -> DataFrame:
    """Per journey (``journey_id``; ``drawn``: the ride follows a shape): where its geometry comes from and what is said about it."""
    per = rides.groupBy("journey_id").agg(F.min("drawn").alias("all"), F.max("drawn").alias("any"), F.count("*").alias("rides"))
    source = F.when(F.col("all"), "GTFS_SHAPES").when(F.col("any"), "MIXED").otherwise("STOP_SEQUENCE")
    # The notices shown to the traveller.
    said = F.when(F.col("all"), None).when(F.col("any"), "Some bus rides are drawn through their stops because the dataset has no shape for them.").otherwise("Bus rides are drawn through their ordered stops: the dataset has no route shapes.")
    always = [F.lit("Walking distance and time are estimates from straight-line distance."), F.lit("Times are the scheduled timetable, not live arrival predictions.")]
    return per.select("journey_id", "rides", source.alias("geometry_source"), F.array_compact(F.array(said, *always)).alias("notices"))


# ---- stations far from the shapes of their services

def _crossed(segs: DataFrame, size: float) -> DataFrame:
    """Pieces in the cells of a grid that they run through."""
    d = segs.withColumn("cy", F.explode(F.sequence(_cell(F.least("ay", "by"), size), _cell(F.greatest("ay", "by"), size))))
    dy = F.when(F.col("by") != F.col("ay"), F.col("by") - F.col("ay"))
    t = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((F.lit(size) * (F.col("cy") + k) - F.col("ay")) / dy, F.lit(float(k))))) for k in (0, 1)]
    x = [F.col("ax") + (F.col("bx") - F.col("ax")) * k for k in t]
    slack = size * 1e-6
    return d.withColumn("cx", F.explode(F.sequence(_cell(F.least(*x) - slack, size), _cell(F.greatest(*x) + slack, size))))


def shape_distances(links: DataFrame, stations: DataFrame, use: DataFrame, shapes: DataFrame, start: float = 0.01) -> DataFrame:
    """Metres from each station of a service (``links``: ``route_id``, ``station``) to the nearest shape of it; no row where the service has none.

    A station looks at its own cell and the eight around it. The nearest piece found there is the nearest of all if it is nearer than the cells
    reach; else the station goes on in a grid of twice the width. So a station meets the pieces around it, not all of its service.
    """
    v = shapes.join(spread(use.select("shape_id", "route_id")), "shape_id")
    segs = previous(v, ["route_id", "shape_id"], "seq", F.struct("lat", "lon"), "p").filter("p is not null")
    segs = stage(segs.select("route_id", F.col("p.lon").alias("ax"), F.col("p.lat").alias("ay"), F.col("lon").alias("bx"), F.col("lat").alias("by")))
    have = segs.select("route_id").distinct()
    left = stage(links.select("route_id", "station").distinct().join(spread(have), "route_id", "left_semi").join(spread(stations.select("station", "lat", "lon")), "station"))
    found, size = [], start
    while left.limit(1).count():
        around = left.withColumn("cy", F.explode(F.sequence(_cell(F.col("lat"), size) - 1, _cell(F.col("lat"), size) + 1))).withColumn("cx", F.explode(F.sequence(_cell(F.col("lon"), size) - 1, _cell(F.col("lon"), size) + 1)))
        d = around.join(spread(_crossed(segs, size)), ["route_id", "cy", "cx"])
        k = F.cos(F.radians("lat"))
        X = lambda c: F.radians(F.col(c) - F.col("lon")) * EARTH * k
        Y = lambda c: F.radians(F.col(c) - F.col("lat")) * EARTH
        best = d.groupBy("route_id", "station").agg(F.min(point_segment(F.lit(0.0), F.lit(0.0), X("ax"), Y("ay"), X("bx"), Y("by"))).alias("meters"))
        sure = F.lit(size) * EARTH * F.radians(F.lit(1.0)) * F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + size)))
        now = stage(left.join(spread(best), ["route_id", "station"], "left").withColumn("done", F.coalesce(F.col("meters") <= sure, F.lit(False)) | F.lit(size > 360.0)))
        found.append(now.filter("done and meters is not null").select("route_id", "station", "meters"))
        left = stage(now.filter("not done").select("station", "route_id", "lat", "lon"))
        size *= 2
    return reduce(DataFrame.unionByName, found) if found else links.select("route_id", "station", F.lit(0.0).alias("meters")).limit(0)


def far_stations(distances: DataFrame, meters: float = STATION_METERS) -> DataFrame:
    return distances.filter(F.col("meters") > meters)
