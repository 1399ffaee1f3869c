"""Route lines, shapes of services and the part of a shape that a ride follows."""

from pyspark.sql import functions as F

from wayline.catalog.journeys import hav
from wayline.operators.stage import stage
from wayline.plans import shapes as sh
from wayline.registry import PARTS, query

PARTS["o_joined"] = """
SELECT * FROM (SELECT *, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon, row_number() OVER o AS n FROM n_line_point WINDOW o AS (PARTITION BY route_id ORDER BY part, seq)) x
WHERE n = 1 OR plat IS DISTINCT FROM lat OR plon IS DISTINCT FROM lon"""
PARTS["o_line_reason"] = """
SELECT l.route_id, CASE WHEN geometry IS NULL OR p.n IS NULL THEN 'MISSING' WHEN coalesce(srid, 0) NOT IN (0, 4326) THEN 'WRONG_SRID' WHEN geometry NOT IN ('LineString', 'MultiLineString') THEN 'UNSUPPORTED_TYPE'
 WHEN NOT p.fits THEN 'COORDINATE_OUT_OF_RANGE' WHEN p.n < 2 THEN 'NO_LENGTH' END AS reason
FROM n_line l LEFT JOIN (SELECT route_id, count(*) AS n, bool_and(coalesce(abs(lat) <= 90 AND abs(lon) <= 180, false)) AS fits FROM o_joined GROUP BY route_id) p ON p.route_id = l.route_id"""


@query("src13_line_reasons", "SELECT route_id, reason FROM o_line_reason")
def src13(t):
    return sh.normalized_lines(t.n_line, t.n_line_point)[1]


@query("src13_joined_lines", "SELECT j.route_id, row_number() OVER (PARTITION BY j.route_id ORDER BY j.n) - 1 AS seq, j.lat, j.lon FROM o_joined j JOIN o_line_reason r ON r.route_id = j.route_id WHERE r.reason IS NULL")
def src13_joined(t):
    return sh.normalized_lines(t.n_line, t.n_line_point)[0]


PARTS["o_used"] = "SELECT shape_id, route_id, count(*) AS n FROM n_shape_trip WHERE trim(shape_id) <> '' GROUP BY shape_id, route_id"
PARTS["o_use"] = "SELECT shape_id, first(route_id ORDER BY n DESC, route_id) AS route_id, CAST(sum(n) AS BIGINT) AS trips, count(*) > 1 AS shared FROM o_used GROUP BY shape_id"
PARTS["o_shape"] = """
SELECT shape_id, lat, lon, row_number() OVER (PARTITION BY shape_id ORDER BY seq) - 1 AS at_, count(*) OVER (PARTITION BY shape_id) AS n FROM (
 SELECT *, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon FROM n_shape WINDOW o AS (PARTITION BY shape_id ORDER BY seq)) x WHERE plat IS NULL OR plat <> lat OR plon <> lon"""


@query("ag6_shape_use", "SELECT shape_id, route_id, trips, shared FROM o_use")
def ag6(t):
    return sh.shape_use(t.n_shape_trip)


@query("src14_shape_points", "SELECT shape_id, at_ AS seq, lat, lon FROM o_shape WHERE n > 1")
def src14(t):
    return sh.usable_shapes(t.n_shape)


@query("sl8_service_shapes", """SELECT u.route_id, row_number() OVER (PARTITION BY u.route_id ORDER BY u.trips DESC, u.shape_id) AS number, u.shape_id, u.trips, s.n AS points, u.shared
FROM o_use u JOIN (SELECT DISTINCT shape_id, n FROM o_shape WHERE n > 1) s ON s.shape_id = u.shape_id""")
def sl8(t):
    return sh.service_shapes(sh.shape_use(t.n_shape_trip), sh.usable_shapes(t.n_shape))


DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
PARTS["o_calendar"] = "SELECT service_id, try_strptime(start_date, '%Y%m%d')::DATE AS s, try_strptime(end_date, '%Y%m%d')::DATE AS e, " + ", ".join(DAYS) + " FROM raw_calendar WHERE service_id IN (SELECT service_id FROM raw_trip)"


@query("ag12_service_period", "SELECT min(s) FILTER (e IS NOT NULL) AS start_date, max(e) FILTER (s IS NOT NULL) AS end_date, concat_ws(',', " + ", ".join(f"CASE WHEN bool_or({d} = '1') THEN '{d}' END" for d in DAYS)
       + ") AS days, count(*) FILTER (s IS NULL OR e IS NULL) AS unreadable FROM o_calendar")
def ag12(t):
    c = t.raw_calendar.withColumn("start_date", F.try_to_date("start_date", "yyyyMMdd")).withColumn("end_date", F.try_to_date("end_date", "yyyyMMdd"))
    return sh.service_period(c, t.raw_trip)


FAR = "{}".format(hav("a.{0}_lat", "a.{0}_lon", "s.lat", "s.lon"))
PARTS["o_slice_ask"] = "SELECT DISTINCT shape_id, board_lat, board_lon, exit_lat, exit_lon FROM n_journey_ride"
PARTS["o_boarded"] = f"""
SELECT a.*, b.first_ FROM o_slice_ask a JOIN (SELECT a.shape_id, a.board_lat, a.board_lon, first(s.at_ ORDER BY {FAR.format('board')}, s.at_) AS first_, min({FAR.format('board')}) AS far
 FROM (SELECT DISTINCT shape_id, board_lat, board_lon FROM o_slice_ask) a JOIN o_shape s ON s.shape_id = a.shape_id AND s.n > 1 GROUP BY 1, 2, 3) b ON b.shape_id = a.shape_id AND b.board_lat = a.board_lat AND b.board_lon = a.board_lon WHERE b.far <= 300"""
PARTS["o_slice"] = f"""
SELECT * FROM (SELECT a.shape_id, a.board_lat, a.board_lon, a.exit_lat, a.exit_lon, a.first_, first(s.at_ ORDER BY {FAR.format('exit')}, s.at_) AS last_, min({FAR.format('exit')}) AS far
 FROM o_boarded a JOIN o_shape s ON s.shape_id = a.shape_id AND s.n > 1 AND s.at_ >= a.first_ GROUP BY 1, 2, 3, 4, 5, 6) x WHERE far <= 300 AND last_ > first_"""


@query("geo15_slices", "SELECT shape_id, board_lat, board_lon, exit_lat, exit_lon, first_ AS first, last_ AS last FROM o_slice")
def geo15(t):
    return sh.slices(t.n_journey_ride, sh.usable_shapes(t.n_shape))


PARTS["o_drawn"] = """
SELECT r.ride_id, r.journey_id, r.shape_id, r.board_lat, r.board_lon, r.exit_lat, r.exit_lon, s.first_, s.last_ FROM n_journey_ride r LEFT JOIN o_slice s
ON s.shape_id = r.shape_id AND s.board_lat = r.board_lat AND s.board_lon = r.board_lon AND s.exit_lat = r.exit_lat AND s.exit_lon = r.exit_lon"""


@query("geo15_ride_lines", """SELECT d.ride_id, s.at_ - d.first_ + 1 AS pos, s.lat, s.lon, 'GTFS_SHAPES' AS source FROM o_drawn d JOIN o_shape s ON s.shape_id = d.shape_id AND s.at_ BETWEEN d.first_ AND d.last_
UNION ALL SELECT ride_id, 0, board_lat, board_lon, 'GTFS_SHAPES' FROM o_drawn WHERE first_ IS NOT NULL UNION ALL SELECT ride_id, last_ - first_ + 2, exit_lat, exit_lon, 'GTFS_SHAPES' FROM o_drawn WHERE first_ IS NOT NULL
UNION ALL SELECT ride_id, 0, board_lat, board_lon, 'STOP_SEQUENCE' FROM o_drawn WHERE first_ IS NULL UNION ALL SELECT ride_id, 1, exit_lat, exit_lon, 'STOP_SEQUENCE' FROM o_drawn WHERE first_ IS NULL""")
def geo15_lines(t):
    return sh.ride_lines(t.n_journey_ride, sh.usable_shapes(t.n_shape), stops(t.n_journey_ride))


def stops(rides):
    two = F.array(*[F.struct(F.lit(k).cast("bigint").alias("pos"), F.col(f"{s}_lat").alias("lat"), F.col(f"{s}_lon").alias("lon")) for k, s in enumerate(("board", "exit"))])
    return rides.select("ride_id", F.explode(two).alias("e")).select("ride_id", "e.*")


@query("bj17_geometry_source", """SELECT journey_id, count(*) AS rides, CASE WHEN bool_and(first_ IS NOT NULL) THEN 'GTFS_SHAPES' WHEN bool_or(first_ IS NOT NULL) THEN 'MIXED' ELSE 'STOP_SEQUENCE' END AS geometry_source,
 CASE WHEN bool_and(first_ IS NOT NULL) THEN 2 ELSE 3 END AS notices FROM o_drawn GROUP BY journey_id""")
def bj17(t):
    r = t.n_journey_ride
    cut = sh.slices(r, sh.usable_shapes(t.n_shape))
    d = r.join(cut, ["shape_id", "board_lat", "board_lon", "exit_lat", "exit_lon"], "left").select("journey_id", F.col("first").isNotNull().alias("drawn"))
    return sh.geometry_source(d).withColumn("notices", F.size("notices"))


PARTS["o_shape_seg"] = "SELECT u.route_id, s.* FROM (SELECT shape_id, n, lead(lat) OVER o AS by_, lead(lon) OVER o AS bx_, lat, lon FROM o_shape WINDOW o AS (PARTITION BY shape_id ORDER BY at_)) s JOIN o_use u ON u.shape_id = s.shape_id WHERE s.n > 1 AND by_ IS NOT NULL"
PARTS["o_far"] = """
SELECT route_id, station, min(sqrt(pow(px + f * dx, 2) + pow(py + f * dy, 2))) AS meters FROM (
 SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, -(px * dx + py * dy) / (dx * dx + dy * dy))) END AS f FROM (
  SELECT l.route_id, l.station, radians(s.lon - l.lon) * 6371008.8e0 * cos(radians(l.lat)) AS px, radians(s.lat - l.lat) * 6371008.8e0 AS py,
   radians(s.bx_ - s.lon) * 6371008.8e0 * cos(radians(l.lat)) AS dx, radians(s.by_ - s.lat) * 6371008.8e0 AS dy
  FROM (SELECT concat('A', b) AS route_id, station, lat, lon FROM n_station) l JOIN o_shape_seg s ON s.route_id = l.route_id) x) y GROUP BY route_id, station"""


def distances(t):
    links = t.n_station.select(F.concat(F.lit("A"), F.col("b").cast("string")).alias("route_id"), "station")
    return sh.shape_distances(links, t.n_station, sh.shape_use(t.n_shape_trip), sh.usable_shapes(t.n_shape))


@query("jn23_station_distances", "SELECT route_id, station, round(meters, 1) AS meters FROM o_far")
def jn23(t):
    return distances(t).withColumn("meters", F.round("meters", 1))


@query("jn23_far_stations", "SELECT route_id, station FROM o_far WHERE meters > 300")
def jn23_far(t):
    return sh.far_stations(distances(t)).select("route_id", "station")
