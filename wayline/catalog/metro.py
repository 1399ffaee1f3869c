"""Metro feed and network."""

from pyspark.sql import functions as F

from wayline.catalog.bus_feed import CLEAN, R6, judged
from wayline.catalog.journeys import hav
from wayline.operators.accept import accepted
from wayline.operators.stage import stage
from wayline.operators import constraints as cn
from wayline.plans import metro as m
from wayline.registry import PARTS, query


def havm(*a):
    return hav(*a).replace("6371008.8e0", "6371000e0")


PARTS["k_stop"] = judged(
    f"""SELECT *, CASE WHEN trim(location_type) = '' THEN 0 ELSE try_cast(location_type AS INT) END AS kind, {CLEAN.format(c='stop_name')} AS name,
      try_cast(stop_lat AS DOUBLE) AS lat0, try_cast(stop_lon AS DOUBLE) AS lon0 FROM raw_m_stop""", "stop_id",
    """CASE WHEN kind IS NULL THEN 'invalid location type' WHEN name = '' THEN 'station without a name' WHEN lat0 IS NULL OR lon0 IS NULL THEN 'invalid coordinates'
      WHEN lat0 < 6 OR lat0 > 38 OR lon0 < 68 OR lon0 > 98 THEN 'coordinates outside the supported region' END""",
    "CASE WHEN trim(stop_id) = '' THEN 'stop without an id' END", "coalesce(kind >= 2, false)", skip_blocks=True)
PARTS["k_ok"] = f"SELECT *, {R6.format(c='lat0')} AS lat, {R6.format(c='lon0')} AS lon, lower(name) AS full_name, regexp_matches(name, '\\s*\\([^()]*\\)\\s*$') AS note, trim(lower(regexp_replace(name, '\\s*\\([^()]*\\)\\s*$', ''))) AS base FROM k_stop WHERE outcome = 'accepted'"
PARTS["k_route"] = judged(f"SELECT *, coalesce(NULLIF({CLEAN.format(c='route_long_name')}, ''), route_short_name) AS name FROM raw_m_route", "route_id",
                          "CASE WHEN name = '' THEN 'route without a name' END", "CASE WHEN trim(route_id) = '' THEN 'route without an id' END")
PARTS["k_trip"] = judged("SELECT *, route_id IN (SELECT route_id FROM k_route WHERE outcome = 'accepted') AS has_route FROM raw_m_trip", "trip_id",
                         "CASE WHEN NOT has_route THEN 'trip of an unknown route' END", "CASE WHEN trim(trip_id) = '' THEN 'trip without an id' END")
PARTS["k_time"] = judged(
    """SELECT *, try_cast(stop_sequence AS INT) AS seq, trip_id IN (SELECT trip_id FROM k_trip WHERE outcome = 'accepted') AS has_trip,
      stop_id IN (SELECT stop_id FROM k_ok) AS has_stop, stop_id IN (SELECT stop_id FROM k_stop WHERE outcome = 'skipped') AS silent FROM raw_m_stop_time""", "trip_id, seq",
    "CASE WHEN NOT has_stop THEN 'stop time of an unknown stop' WHEN seq IS NULL OR seq < 0 THEN 'invalid stop sequence' END",
    "CASE WHEN NOT has_trip THEN 'stop time of an unknown trip' END", "silent AND has_trip", late=True)
PARTS["k_link"] = f"""
SELECT a.stop_id AS a, b.stop_id AS b FROM k_ok a JOIN k_ok b ON a.parent_station = b.stop_id
UNION SELECT a.stop_id, b.stop_id FROM k_ok a JOIN k_ok b ON a.base = b.base AND a.stop_id < b.stop_id AND (a.full_name = b.full_name OR a.note <> b.note)
 AND {havm('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 300"""
PARTS["k_member"] = """
WITH RECURSIVE e AS (SELECT a, b FROM k_link UNION SELECT b, a FROM k_link), walk AS (SELECT stop_id, stop_id AS pt FROM k_ok UNION SELECT w.stop_id, e.b FROM walk w JOIN e ON e.a = w.pt)
SELECT stop_id, min(pt) AS station FROM walk GROUP BY stop_id"""
PARTS["k_call"] = """
SELECT * FROM (SELECT t.trip_id, t.seq, m.station, lag(m.station) OVER (PARTITION BY t.trip_id ORDER BY t.seq) AS before FROM k_time t JOIN k_member m ON m.stop_id = t.stop_id WHERE t.outcome = 'accepted') x
WHERE before IS NULL OR before <> station"""
PARTS["k_first"] = "SELECT m.station, arg_min(k.lat, k.row_pos) AS lat, arg_min(k.lon, k.row_pos) AS lon FROM k_ok k JOIN k_member m ON m.stop_id = k.stop_id GROUP BY m.station"
PARTS["k_result"] = f"""
SELECT t.trip_id, t.route_id, coalesce(g.n, 0) AS stations, CASE WHEN g.n IS NULL THEN 'trip without stop times' WHEN g.n < 2 THEN 'trip with fewer than two stations'
 WHEN g.far THEN 'trip with an implausible distance between stations' END AS reason FROM (SELECT * FROM k_trip WHERE outcome = 'accepted') t
LEFT JOIN (SELECT c.trip_id, count(*) AS n, bool_or(coalesce({havm('b.lat', 'b.lon', 'a.lat', 'a.lon')} > 40000, false)) AS far FROM k_call c JOIN k_first a ON a.station = c.station LEFT JOIN k_first b ON b.station = c.before GROUP BY c.trip_id) g
ON g.trip_id = t.trip_id"""
PARTS["k_conn"] = """
SELECT r.route_id, c.before AS from_station, c.station AS to_station, count(*) AS trips FROM k_call c JOIN k_result r ON r.trip_id = c.trip_id AND r.reason IS NULL WHERE c.before IS NOT NULL GROUP BY ALL"""
PARTS["k_raw_pattern"] = """
SELECT DISTINCT route_id, least(array_to_string(l, '|'), array_to_string(list_reverse(l), '|')) AS key, len(l) AS n FROM (
 SELECT r.route_id, c.trip_id, list(c.station ORDER BY c.seq) AS l FROM k_call c JOIN k_result r ON r.trip_id = c.trip_id AND r.reason IS NULL GROUP BY r.route_id, c.trip_id) x"""
PARTS["k_pattern"] = """
SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY n DESC, key) AS number FROM k_raw_pattern p WHERE NOT EXISTS (SELECT 1 FROM k_raw_pattern q WHERE q.route_id = p.route_id AND q.n > p.n
 AND (contains('|' || q.key || '|', '|' || p.key || '|') OR contains('|' || array_to_string(list_reverse(string_split(q.key, '|')), '|') || '|', '|' || p.key || '|')))"""
PARTS["k_link_line"] = "SELECT route_id, number, unnest(string_split(key, '|')) AS station, generate_subscripts(string_split(key, '|'), 1) AS sequence FROM k_pattern"
PARTS["k_edge"] = "SELECT DISTINCT route_id, least(from_station, to_station) AS a, greatest(from_station, to_station) AS b FROM k_conn"
PARTS["k_line"] = "SELECT *, CASE WHEN regexp_full_match(route_color, '[0-9A-Fa-f]{6}') THEN concat('#', upper(route_color)) END AS color FROM k_route WHERE outcome = 'accepted' AND route_id IN (SELECT route_id FROM k_result WHERE reason IS NULL)"
PARTS["k_group"] = """
WITH RECURSIVE pair AS (SELECT DISTINCT e.route_id AS x, o.owner AS y FROM k_edge e JOIN (SELECT a, b, min(route_id) AS owner FROM k_edge GROUP BY a, b) o ON o.a = e.a AND o.b = e.b AND o.owner <> e.route_id
  JOIN k_line c ON c.route_id = e.route_id JOIN k_line d ON d.route_id = o.owner AND d.color = c.color),
 e2 AS (SELECT x, y FROM pair UNION SELECT y, x FROM pair), walk AS (SELECT route_id, route_id AS pt FROM k_line UNION SELECT w.route_id, e2.y FROM walk w JOIN e2 ON e2.x = w.pt)
SELECT route_id, min(pt) AS group_id FROM walk GROUP BY route_id"""
PARTS["k_base"] = "SELECT g.*, l.name, CASE WHEN l.name LIKE '%)' THEN split_part(l.name, ' (', 1) ELSE l.name END AS base FROM k_group g JOIN k_line l ON l.route_id = g.route_id"
PARTS["k_named"] = "SELECT group_id, arg_min(base, (-n, base)) AS group_name FROM (SELECT group_id, base, count(*) AS n FROM k_base GROUP BY group_id, base) x GROUP BY group_id"


def feed(t) -> m.Import:
    return m.Import(t.raw_m_stop, t.raw_m_route, t.raw_m_trip, t.raw_m_stop_time)


@query("mi1_stops", "SELECT row_pos, outcome, reason FROM k_stop")
def mi1(t):
    return m.stops(t.raw_m_stop).select("row_pos", "outcome", "reason")


@query("mi2_routes", """SELECT row_pos, outcome, reason, name, CASE WHEN route_short_name <> '' AND route_short_name <> name THEN route_short_name END AS short_name,
 CASE WHEN regexp_full_match(route_color, '[0-9A-Fa-f]{6}') THEN concat('#', upper(route_color)) END AS color FROM k_route""")
def mi2(t):
    return m.routes(t.raw_m_route).select("row_pos", "outcome", "reason", "name", "short_name", "color")


@query("mi3_trips", "SELECT row_pos, outcome, reason FROM k_trip")
def mi3(t):
    return feed(t).trips.select("row_pos", "outcome", "reason")


@query("mi4_stop_times", "SELECT row_pos, outcome, reason FROM k_time")
def mi4(t):
    return feed(t).times.select("row_pos", "outcome", "reason")


@query("mi5_trip_results", "SELECT trip_id, route_id, stations, reason FROM k_result")
def mi5(t):
    return feed(t).results


@query("mi6_lines_without_trips", "SELECT route_id FROM k_route WHERE outcome = 'accepted' AND route_id NOT IN (SELECT route_id FROM k_line)")
def mi6(t):
    f = feed(t)
    return accepted(f.routes).join(f.lines, "route_id", "left_anti").select("route_id")


@query("gr1_stations", "SELECT stop_id, station FROM k_member")
def gr1(t):
    return feed(t).member


@query("ag7_ag8_station_records", """
SELECT *, CASE WHEN has_child THEN CASE WHEN n_eff = 1 THEN one_eff ELSE 'UNKNOWN' END ELSE pacc END AS wheelchair FROM (
 SELECT m.station, coalesce(min(CASE WHEN k.kind = 1 THEN p.name END), arg_min(k.name, (k.note, k.stop_id))) AS name, floor(coalesce(min(p.lat), avg(k.lat)) * 1e6 + 0.5e0) / 1e6 AS lat,
  floor(coalesce(min(p.lon), avg(k.lon)) * 1e6 + 0.5e0) / 1e6 AS lon, array_to_string(list(k.stop_id ORDER BY k.stop_id), ',') AS stop_ids, count(*) AS stop_count
 FROM k_ok k JOIN k_member m ON m.stop_id = k.stop_id LEFT JOIN k_parent p ON p.station = m.station GROUP BY m.station) a
JOIN (SELECT m.station AS st, bool_or(k.kind <> 1) AS has_child, coalesce(min(p.acc), 'UNKNOWN') AS pacc,
  count(DISTINCT CASE WHEN k.kind <> 1 THEN CASE k.wheelchair_boarding WHEN '1' THEN 'ACCESSIBLE' WHEN '2' THEN 'INACCESSIBLE' ELSE coalesce(p.acc, 'UNKNOWN') END END) AS n_eff,
  min(CASE WHEN k.kind <> 1 THEN CASE k.wheelchair_boarding WHEN '1' THEN 'ACCESSIBLE' WHEN '2' THEN 'INACCESSIBLE' ELSE coalesce(p.acc, 'UNKNOWN') END END) AS one_eff
 FROM k_ok k JOIN k_member m ON m.stop_id = k.stop_id LEFT JOIN k_parent p ON p.station = m.station GROUP BY m.station) b ON b.st = a.station""".replace("SELECT *, CASE WHEN has_child", "SELECT station, name, lat, lon, stop_ids, stop_count, CASE WHEN has_child", 1))
def ag7(t):
    f = feed(t)
    return m.station_records(f.stop, f.member)


PARTS["k_parent"] = """
SELECT m.station, arg_min(k.name, k.stop_id) AS name, arg_min(k.lat, k.stop_id) AS lat, arg_min(k.lon, k.stop_id) AS lon,
 arg_min(CASE k.wheelchair_boarding WHEN '1' THEN 'ACCESSIBLE' WHEN '2' THEN 'INACCESSIBLE' ELSE 'UNKNOWN' END, k.stop_id) AS acc FROM k_ok k JOIN k_member m ON m.stop_id = k.stop_id WHERE k.kind = 1 GROUP BY m.station"""


@query("mi7_shared_names", "SELECT base AS name, count(*) AS stations FROM (SELECT DISTINCT m.station, k.base FROM k_ok k JOIN k_member m ON m.stop_id = k.stop_id) x GROUP BY base HAVING count(*) > 1")
def mi7(t):
    f = feed(t)
    d = f.stop.join(f.member, "stop_id").select("station", m.base_key(F.col("name")).alias("name")).distinct()
    return d.groupBy("name").agg(F.count(F.lit(1)).alias("stations")).filter("stations > 1")


@query("ag5_connections", "SELECT * FROM k_conn")
def ag5(t):
    return feed(t).connections


@query("gr3_line_patterns", "SELECT route_id, key, n, number FROM k_pattern")
def gr3(t):
    return feed(t).patterns


@query("gr4_adjacency", "SELECT * FROM k_edge")
def gr4(t):
    return m.undirected(feed(t).connections)


@query("gr2_logical_lines", "SELECT b.route_id, b.group_id, n.group_name, CASE WHEN b.name LIKE '%)' THEN replace(split_part(b.name, ' (', 2), ')', '') END AS branch_name FROM k_base b JOIN k_named n ON n.group_id = b.group_id")
def gr2(t):
    return feed(t).groups


PARTS["k_count"] = "SELECT l.station, count(DISTINCT l.route_id) AS services, count(DISTINCT g.group_id) AS lines FROM k_link_line l JOIN k_group g ON g.route_id = l.route_id GROUP BY l.station"


@query("ag9_interchanges", "SELECT station, services, lines, lines >= 2 AS interchange FROM k_count")
def ag9(t):
    f = feed(t)
    return m.line_counts(m.station_lines(f.patterns), f.groups)


@query("sl9_station_lines", "SELECT route_id, number, station, CAST(sequence AS BIGINT) AS sequence FROM k_link_line")
def sl9(t):
    return m.station_lines(feed(t).patterns)


@query("wn8_neighbours", """SELECT route_id, station, prev, next, sequence FROM (SELECT *, row_number() OVER (PARTITION BY route_id, station ORDER BY n DESC, number, sequence) AS best FROM (
 SELECT l.route_id, l.number, l.station, p.n, CAST(l.sequence AS BIGINT) AS sequence, lag(l.station) OVER w AS prev, lead(l.station) OVER w AS next FROM k_link_line l JOIN k_pattern p ON p.route_id = l.route_id AND p.number = l.number
 WINDOW w AS (PARTITION BY l.route_id, l.number ORDER BY l.sequence)) x) y WHERE best = 1""")
def wn8(t):
    p = feed(t).patterns.withColumn("l", F.split("key", r"\|"))
    at = p.select("route_id", "number", "n", "l", F.posexplode("l").alias("i", "station"))
    # Neighbours are read from the pattern's own list; get() is NULL past either end.
    d = at.select("route_id", "station", "number", "n", (F.col("i") + 1).alias("sequence"), F.get("l", F.col("i") - 1).alias("prev"), F.get("l", F.col("i") + 1).alias("next"))
    best = d.groupBy("route_id", "station").agg(F.min(F.struct((-F.col("n")).alias("o"), "number", "sequence", "prev", "next")).alias("b"))
    return best.select("route_id", "station", "b.prev", "b.next", "b.sequence")


# Rides to rebuild: the two ends of every third stretch of each valid trip.
PARTS["k_ride"] = "SELECT trip_id AS ride_id, arg_min(station, seq) AS board, arg_max(station, seq) AS exit, count(*) - 1 AS hops FROM k_call WHERE trip_id IN (SELECT trip_id FROM k_result WHERE reason IS NULL) GROUP BY trip_id"
PARTS["k_walk"] = """
WITH RECURSIVE adj AS (SELECT a, b FROM k_edge UNION SELECT b, a FROM k_edge), ask AS (SELECT DISTINCT board, exit, hops FROM k_ride), w AS (
 SELECT DISTINCT board, exit, hops, board AS pt, [board] AS path FROM ask
 UNION ALL SELECT w.board, w.exit, w.hops, adj.b, list_append(w.path, adj.b) FROM w JOIN adj ON adj.a = w.pt WHERE len(w.path) <= w.hops AND NOT list_contains(w.path, adj.b))
SELECT board, exit, hops, min(path) AS path FROM w WHERE pt = exit AND len(path) = hops + 1 GROUP BY board, exit, hops HAVING count(*) = 1"""


def rides(f):
    return stage(f.calls.join(f.valid.select("trip_id"), "trip_id", "left_semi").groupBy(F.col("trip_id").alias("ride_id"))
                 .agg(F.min_by("station", "seq").alias("board"), F.max_by("station", "seq").alias("exit"), (F.count(F.lit(1)) - 1).alias("hops")))


@query("gr5_gr6_ride_paths", "SELECT r.ride_id, array_to_string(w.path, '|') AS path FROM k_ride r JOIN k_walk w ON w.board = r.board AND w.exit = r.exit AND w.hops = r.hops")
def gr5(t):
    f = feed(t)
    return m.reconstruct(rides(f), f.connections).select("ride_id", F.array_join("path", "|").alias("path"))


@query("jn19_services_on_path", """
SELECT ride_id, route_id FROM (SELECT r.ride_id, w.hops, w.path, unnest(generate_series(1, len(w.path) - 1)) AS i FROM k_ride r JOIN k_walk w ON w.board = r.board AND w.exit = r.exit AND w.hops = r.hops) x
JOIN k_edge e ON e.a = least(path[i], path[i + 1]) AND e.b = greatest(path[i], path[i + 1]) GROUP BY ride_id, route_id, hops HAVING count(DISTINCT i) = hops""")
def jn19(t):
    f = feed(t)
    return m.services_on_path(stage(m.reconstruct(rides(f), f.connections)), f.connections)


@query("dq8_metro_counts", """
SELECT 'stations' AS check_name, count(DISTINCT station) AS n FROM k_link_line UNION ALL SELECT 'services', count(*) FROM k_line UNION ALL SELECT 'logical lines', count(DISTINCT group_id) FROM k_group
UNION ALL SELECT 'station line links', count(*) FROM k_link_line UNION ALL SELECT 'connections', count(*) FROM k_conn UNION ALL SELECT 'trips imported', count(*) FROM k_result WHERE reason IS NULL""")
def dq8(t):
    f = feed(t)
    links = m.station_lines(f.patterns)
    return cn.violations({"stations": links.select("station").distinct(), "services": f.lines, "logical lines": f.groups.select("group_id").distinct(),
                     "station line links": links, "connections": f.connections, "trips imported": f.valid})


@query("dq9_shared_stations", "SELECT station, services, lines FROM k_count WHERE services >= 2 AND lines = 1")
def dq9(t):
    f = feed(t)
    return m.line_counts(m.station_lines(f.patterns), f.groups).filter("services >= 2 and lines = 1").select("station", "services", "lines")


@query("dq10_metro_problems", """
SELECT 'station without line' AS check_name, count(*) AS n FROM (SELECT DISTINCT station FROM k_member) s WHERE station NOT IN (SELECT station FROM k_link_line)
UNION ALL SELECT 'line without connections', count(*) FROM k_line WHERE route_id NOT IN (SELECT route_id FROM k_conn)
UNION ALL SELECT 'line without colour', count(*) FROM k_line WHERE color IS NULL
UNION ALL SELECT 'sequence gaps', count(*) FROM (SELECT route_id, number FROM k_link_line GROUP BY route_id, number HAVING min(sequence) <> 1 OR max(sequence) <> count(*)) d
UNION ALL SELECT 'connection off pattern', count(*) FROM k_conn c WHERE NOT EXISTS (SELECT 1 FROM k_link_line l WHERE l.route_id = c.route_id AND l.station = c.from_station) OR NOT EXISTS (SELECT 1 FROM k_link_line l WHERE l.route_id = c.route_id AND l.station = c.to_station)
UNION ALL SELECT 'identical positions', count(*) FROM (SELECT lat, lon FROM k_first GROUP BY lat, lon HAVING count(*) > 1) d""")
def dq10(t):
    f = feed(t)
    links = stage(m.station_lines(f.patterns))
    on = links.select("route_id", "station").distinct()
    ends = f.connections.join(on.withColumnRenamed("station", "from_station"), ["route_id", "from_station"], "left_semi").join(
        on.withColumnRenamed("station", "to_station"), ["route_id", "to_station"], "left_semi")
    off = f.connections.join(ends, ["route_id", "from_station", "to_station"], "left_anti")
    per = links.groupBy("route_id", "number").agg(F.min("sequence").alias("a"), F.max("sequence").alias("b"), F.count(F.lit(1)).alias("c"))
    first = f.stop.join(f.member, "stop_id").groupBy("station").agg(F.min_by(F.struct("lat", "lon"), "row_pos").alias("f")).select("station", "f.lat", "f.lon")
    return cn.violations({"station without line": f.member.select("station").distinct().join(links, "station", "left_anti"),
                     "line without connections": f.lines.join(f.connections, "route_id", "left_anti"), "line without colour": f.lines.filter("color is null"),
                     "sequence gaps": per.filter("a <> 1 or b <> c"), "connection off pattern": off,
                     "identical positions": cn.not_unique(first, "lat", "lon")})
