"""Pattern layer, timetable relations and bus data-quality suites."""

from pyspark.sql import functions as F

from wayline.operators import constraints as c
from wayline.plans import bus_quality as q, patterns as p
from wayline.registry import PARTS, query

# The cross-check looks at a trip as one list of calls; the library works on call rows.
PARTS["o_calls"] = """
SELECT trip_id, list(struct_pack(place := stop_id, seq := stop_sequence, a := coalesce(arrival_s, departure_s), d := coalesce(departure_s, arrival_s))
                     ORDER BY stop_sequence) AS calls
FROM a_stop_time GROUP BY trip_id"""
PARTS["o_sig"] = """
SELECT trip_id, md5(array_to_string([CAST(c.place AS VARCHAR) FOR c IN calls], ',')) AS signature, len(calls) AS stops, calls[1].d AS first_departure
FROM o_calls WHERE len(calls) > 1 AND len([c FOR c IN calls IF c.d IS NULL]) = 0"""
PARTS["o_trip_pattern"] = r"""
SELECT a_trip.*, signature, CASE WHEN signature IS NOT NULL THEN
       regexp_replace(md5('BUS:bus-pattern:' || route_id || ':' || signature), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\1-\2-\3-\4-\5') END AS pattern_id
FROM a_trip LEFT JOIN o_sig USING (trip_id)"""


def _shared(column: str) -> str:
    """The value of a list all of whose members are one and the same."""
    return f"CASE WHEN count({column}) = count(*) AND len(list_distinct(list({column}))) = 1 THEN list({column})[1] END AS {column}"


PARTS["o_pattern"] = f"""
SELECT pattern_id, any_value(route_id) AS route_id, any_value(k.signature) AS signature, any_value(stops) AS stop_count, count(*) AS trip_count,
       min(first_departure) AS first_departure, max(first_departure) AS last_departure, {_shared('direction_id')}, {_shared('headsign')}
FROM o_trip_pattern k JOIN o_sig USING (trip_id) GROUP BY pattern_id"""
PARTS["o_pattern_stop"] = """
SELECT pattern_id, any_value(route_id) AS route_id, any_value(signature) AS signature, idx, call.place AS stop_id, min(call.seq) AS stop_sequence,
       CAST(greatest(0, round(avg(call.a - start))) AS BIGINT) AS offset_s
FROM (SELECT pattern_id, route_id, signature, calls[1].d AS start, unnest(range(len(calls))) AS idx, unnest(calls) AS call
      FROM o_trip_pattern JOIN o_calls USING (trip_id) WHERE pattern_id IS NOT NULL) x
GROUP BY pattern_id, idx, call.place"""


# ---- SQL of the constraints of wayline.operators.constraints

def tally(checks: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS check_name, CAST(({sql}) AS BIGINT) AS n" for name, sql in checks.items())


def rows_of(table: str, where: str = "true") -> str:
    return f"SELECT count(*) FROM {table} WHERE {where}"


def not_unique(table: str, keys: str) -> str:
    return f"SELECT count(*) FROM (SELECT {keys} FROM {table} GROUP BY ALL HAVING count(*) > 1) twice"


def dangling(table: str, parent: str, key: str) -> str:
    return f"SELECT count(*) FROM {table} ANTI JOIN {parent} USING ({key}) WHERE {key} IS NOT NULL"


def gaps(table: str, key: str, index: str) -> str:
    return (f"SELECT count(*) FROM (SELECT list({index} ORDER BY {index}) AS found FROM {table} GROUP BY {key}) every "
            "WHERE found <> range(len(found))")


def falling(table: str, key: str, order: str, value: str, since: str, operator: str = "<", what: str = "count(*)") -> str:
    """Compares neighbours by joining each row to the one numbered before it."""
    numbered = f"SELECT *, rank() OVER (PARTITION BY {key} ORDER BY {order}) AS place FROM {table}"
    return (f"SELECT {what} FROM ({numbered}) here JOIN ({numbered}) before ON before.{key} = here.{key} AND before.place + 1 = here.place "
            f"WHERE here.{value} {operator} before.{since}")


def layer(t) -> p.Layer:
    return p.Layer(t.a_stop_time, t.a_trip)


@query("ag1_signatures", "SELECT trip_id, signature, stops, first_departure FROM o_sig")
def ag1(t):
    return p.signatures(t.a_stop_time).select("trip_id", "signature", "stops", "first_departure")


@query("ag2_patterns", "SELECT * FROM o_pattern")
def ag2(t):
    return p.patterns(p.signatures(t.a_stop_time), t.a_trip)


@query("ag3_pattern_stops", "SELECT pattern_id, idx, stop_id, stop_sequence, offset_s FROM o_pattern_stop")
def ag3(t):
    return layer(t).stops.select("pattern_id", "idx", "stop_id", "stop_sequence", "offset_s")


@query("jn12_stop_time_pattern", """
SELECT st.trip_id, st.stop_sequence, p.pattern_id FROM a_stop_time st JOIN o_sig s ON s.trip_id = st.trip_id
JOIN a_trip t ON t.trip_id = st.trip_id JOIN o_pattern p ON p.route_id = t.route_id AND p.signature = s.signature""")
def jn12(t):
    tp = layer(t).trips
    return (t.a_stop_time.select("trip_id", "stop_sequence")
            .join(tp.filter("pattern_id is not null").select("trip_id", "pattern_id"), "trip_id"))


@query("jn13_trip_pattern", "SELECT trip_id, route_id, pattern_id FROM o_trip_pattern")
def jn13(t):
    return layer(t).trips.select("trip_id", "route_id", "pattern_id")


@query("jn14_route_agency", """
SELECT r.route_id, r.long_name, a.agency_name FROM a_route r LEFT JOIN a_agency a ON a.agency_id = r.agency_id""")
def jn14(t):
    return t.a_route.join(t.a_agency, "agency_id", "left").select("route_id", "long_name", "agency_name")


@query("wn1_position", """
SELECT trip_id, stop_sequence, row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence) - 1 AS idx FROM a_stop_time""")
def wn1(t):
    return p.timed_positions(t.a_stop_time.select("trip_id", "stop_sequence"))


@query("wn2_times_backwards", """
SELECT DISTINCT trip_id FROM (SELECT trip_id, arrival_s, lag(departure_s) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS before
FROM a_stop_time) x WHERE arrival_s < before""")
def wn2(t):
    return q.times_backwards(t.a_stop_time)


@query("wn3_pattern_steps", """
SELECT pattern_id, idx, offset_s, stop_sequence, lag(offset_s) OVER w AS prev_offset, lag(stop_sequence) OVER w AS prev_sequence
FROM o_pattern_stop WINDOW w AS (PARTITION BY pattern_id ORDER BY idx)""")
def wn3(t):
    return q.pattern_steps(layer(t).stops)


@query("wn4_first_departure", """
SELECT trip_id, arg_min(stop_id, stop_sequence) AS first_stop, min(stop_sequence) AS first_sequence FROM a_stop_time GROUP BY trip_id""")
def wn4(t):
    return t.a_stop_time.groupBy("trip_id").agg(F.min_by("stop_id", "stop_sequence").alias("first_stop"),
                                                F.min("stop_sequence").alias("first_sequence"))


@query("ag11_expected_wait", """
SELECT pattern_id, CASE WHEN trip_count >= 2 AND last_departure > first_departure
  THEN CAST(trunc(greatest(120, least(900, (last_departure - first_departure) / (trip_count - 1) / 2))) AS BIGINT)
  ELSE 900 END AS wait_s FROM o_pattern""")
def ag11(t):
    pat = layer(t).patterns
    return pat.select("pattern_id", p.expected_wait(F.col("trip_count"), F.col("first_departure"),
                                                    F.col("last_departure")).cast("bigint").alias("wait_s"))


@query("ag10_stops_served", """
SELECT stop_id, count(DISTINCT pattern_id) AS serving FROM o_pattern_stop GROUP BY stop_id""")
def ag10(t):
    made = layer(t)
    pat, ps = made.patterns, made.stops
    return p.stops_served(ps, pat)


@query("src18_network_extract", """
SELECT p.pattern_id, p.route_id, a.agency_name FROM o_pattern p JOIN a_route r ON r.route_id = p.route_id AND r.active
LEFT JOIN a_agency a ON a.agency_id = r.agency_id
WHERE NOT EXISTS (SELECT 1 FROM o_pattern_stop ps JOIN a_stop s ON s.stop_id = ps.stop_id WHERE ps.pattern_id = p.pattern_id AND NOT s.active)""")
def src18(t):
    made = layer(t)
    pat, ps = made.patterns, made.stops
    routes = t.a_route.join(t.a_agency, "agency_id", "left").select("route_id", "agency_name")
    return (p.usable_patterns(pat, ps, t.a_stop, t.a_route).join(routes, "route_id")
            .select("pattern_id", "route_id", "agency_name"))


@query("src18_served_stops", """
SELECT stop_id, stop_name FROM a_stop s WHERE active AND EXISTS (SELECT 1 FROM o_pattern_stop p WHERE p.stop_id = s.stop_id)""")
def src18_stops(t):
    return (t.a_stop.filter("active").join(layer(t).stops, "stop_id", "left_semi").select("stop_id", "stop_name"))


@query("src17_current_dataset", """
SELECT o_custkey AS source, max(o_orderdate) AS imported_at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version
FROM orders GROUP BY o_custkey""")
def src17(t):
    return t.orders.groupBy(F.col("o_custkey").alias("source")).agg(
        F.max("o_orderdate").alias("imported_at"),
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("version"))


@query("dq3_counts", tally({
    "agency": rows_of("a_agency"), "stop": rows_of("a_stop"), "stop in use": rows_of("a_stop", "active"), "route": rows_of("a_route"),
    "route in use": rows_of("a_route", "active"), "service": rows_of("a_service"), "service exception": rows_of("a_service_date_raw"),
    "trip": rows_of("a_trip"), "shape": "SELECT count(DISTINCT shape_id) FROM raw_trip", "call": rows_of("a_stop_time")}))
def dq3(t):
    every, active = F.lit(True), F.col("active")
    return (q.flags(t.a_stop, {"stop": every, "stop in use": active}).unionByName(q.flags(t.a_route, {"route": every, "route in use": active}))
            .unionByName(q.measures(t.raw_trip, {"shape": F.count_distinct("shape_id")}))
            .unionByName(c.violations({"agency": t.a_agency, "service": t.a_service, "service exception": t.a_service_date_raw,
                                       "trip": t.a_trip, "call": t.a_stop_time})))


_REFERENCES = {"trip.route_id": ("a_trip", "a_route", "route_id"), "trip.service_id": ("a_trip", "a_service", "service_id"),
               "route.agency_id": ("a_route", "a_agency", "agency_id"), "call.trip_id": ("a_stop_time", "a_trip", "trip_id"),
               "call.stop_id": ("a_stop_time", "a_stop", "stop_id")}
_KEYS = {"stop": ("raw_stop", "stop_id"), "route": ("raw_route", "route_id"), "trip": ("raw_trip", "trip_id")}


@query("dq4_problems", tally(
    {f"{k} names no row": dangling(*v) for k, v in _REFERENCES.items()}
    | {f"{k} key repeated in the feed": not_unique(*v) for k, v in _KEYS.items()}
    | {"trip.shape_id names no row": dangling("(SELECT shape_id FROM raw_trip WHERE trim(shape_id) <> '') shaped", "raw_shape", "shape_id"),
       "trip without two calls": "SELECT (SELECT count(*) FROM a_trip) - count(*) FROM a_trip JOIN o_calls USING (trip_id) WHERE len(calls) >= 2",
       "trip arrives before it left": falling("a_stop_time", "trip_id", "stop_sequence", "arrival_s", "departure_s", what="count(DISTINCT here.trip_id)"),
       "stop off the globe": rows_of("a_stop", "abs(lat) > 90 OR abs(lon) > 180"),
       "stop outside the region": rows_of("a_stop", "least(lat - 6, 38 - lat, lon - 68, 98 - lon) < 0")}))
def dq4(t):
    lat, lon = F.col("lat"), F.col("lon")
    get = lambda name: getattr(t, name)
    checks = {f"{k} names no row": c.dangling(get(df), get(parent), key) for k, (df, parent, key) in _REFERENCES.items()}
    checks |= {f"{k} key repeated in the feed": c.not_unique(get(df), key) for k, (df, key) in _KEYS.items()}
    checks["trip.shape_id names no row"] = c.dangling(t.raw_trip.filter("trim(shape_id) <> ''"), t.raw_shape, "shape_id")
    checks["trip without two calls"] = c.child_count(t.a_trip, t.a_stop_time, "trip_id", F.col("children") >= 2)
    checks["trip arrives before it left"] = q.times_backwards(t.a_stop_time)
    return c.violations(checks).unionByName(q.flags(t.a_stop, {
        "stop off the globe": (F.abs(lat) > 90) | (F.abs(lon) > 180), "stop outside the region": ~q.in_india(lat, lon)}))


@query("dq5_relationships", tally({
    "route that has trips": "SELECT count(*) FROM a_route SEMI JOIN a_trip USING (route_id)",
    "stop that is called at": "SELECT count(*) FROM a_stop SEMI JOIN a_stop_time USING (stop_id)",
    "long name of several routes": not_unique("a_route", "long_name"),
    "lowest stop_sequence": "SELECT min(stop_sequence) FROM a_stop_time", "highest stop_sequence": "SELECT max(stop_sequence) FROM a_stop_time",
    "latest departure": "SELECT max(departure_s) FROM a_stop_time"}))
def dq5(t):
    return c.violations({"route that has trips": t.a_route.join(t.a_trip, "route_id", "left_semi"),
                         "stop that is called at": t.a_stop.join(t.a_stop_time, "stop_id", "left_semi"),
                         "long name of several routes": c.not_unique(t.a_route, "long_name")}).unionByName(
        q.measures(t.a_stop_time, {"lowest stop_sequence": F.min("stop_sequence"), "highest stop_sequence": F.max("stop_sequence"),
                                   "latest departure": F.max("departure_s")}))


@query("dq6_patterns", tally({
    "pattern key (route_id, signature) repeated": not_unique("o_pattern", "route_id, signature"),
    "pattern without two stops": rows_of("o_pattern", "stop_count < 2"),
    "pattern.stop_count is not the number of its stops": """SELECT count(*) FROM o_pattern WHERE stop_count <>
        coalesce((SELECT count(*) FROM o_pattern_stop s WHERE s.pattern_id = o_pattern.pattern_id), 0)""",
    "pattern_stop.idx has gaps": gaps("o_pattern_stop", "pattern_id", "idx"),
    "pattern_stop.offset_s falls": falling("o_pattern_stop", "pattern_id", "idx", "offset_s", "offset_s"),
    "pattern_stop.stop_sequence does not rise": falling("o_pattern_stop", "pattern_id", "idx", "stop_sequence", "stop_sequence", "<="),
    "trip.pattern_id names no row": dangling("o_trip_pattern", "o_pattern", "pattern_id"),
    "trip.route_id is not that of its pattern": "SELECT count(*) FROM o_trip_pattern t JOIN o_pattern p USING (pattern_id) WHERE t.route_id <> p.route_id"}))
def dq6(t):
    made = layer(t)
    return q.pattern_report(made.patterns, made.stops, made.trips)


@query("dq7_compression", tally({"call rows": rows_of("a_stop_time"), "pattern stop rows": rows_of("o_pattern_stop"),
                                 "trip without a pattern": rows_of("o_trip_pattern", "pattern_id IS NULL")}))
def dq7(t):
    made = layer(t)
    return c.violations({"call rows": t.a_stop_time, "pattern stop rows": made.stops,
                         "trip without a pattern": made.trips.filter("pattern_id is null")})
