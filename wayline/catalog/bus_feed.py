"""Bus feed import rules over the raw text tables."""

from pyspark.sql import functions as F

from wayline.functions.scalars import DAYS
from wayline.operators.accept import accepted
from wayline.plans import bus_feed as b
from wayline.registry import PARTS, query


def judged(src: str, key: str, why: str, always: str = "NULL", skip: str = "false", late: bool = False,
           skip_blocks: bool = False) -> str:
    """The import rule as SQL: the first acceptable row of a key wins."""
    wins = "always IS NULL AND ((NOT skip AND why IS NULL)" + (" OR skip)" if skip_blocks else ")")
    own = " AND why IS NULL" if late else ""
    return f"""
SELECT *, CASE WHEN outcome = 'rejected' THEN coalesce(always, why) END AS reason FROM (
 SELECT *, CASE WHEN always IS NOT NULL THEN 'rejected' WHEN row_pos > first_pos{own} THEN 'duplicate' WHEN skip THEN 'skipped'
               WHEN why IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS outcome FROM (
  SELECT *, min(CASE WHEN {wins} THEN row_pos END) OVER (PARTITION BY {key}) AS first_pos FROM (
   SELECT *, {always} AS always, {skip} AS skip, {why} AS why FROM ({src}))))"""


CLEAN = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
SEC = ("CASE WHEN regexp_full_match({c}, '\\d{{1,2}}:[0-5]\\d:[0-5]\\d') AND CAST(split_part({c}, ':', 1) AS INT) <= 47 "
       "THEN CAST(split_part({c}, ':', 1) AS INT) * 3600 + CAST(split_part({c}, ':', 2) AS INT) * 60 + CAST(split_part({c}, ':', 3) AS INT) END")
R6 = "floor({c} * 1e6 + 0.5) / 1e6"
DAY = "CASE WHEN regexp_full_match({c}, '\\d{{8}}') THEN CAST(try_strptime({c}, '%Y%m%d') AS DATE) END"

PARTS["f_agency"] = judged(f"SELECT *, {CLEAN.format(c='agency_name')} AS name FROM raw_agency", "agency_id", "CAST(NULL AS VARCHAR)",
                           "CASE WHEN trim(agency_id) = '' OR name = '' THEN 'agency without an id or name' END")
PARTS["f_stop"] = judged(
    f"SELECT *, {CLEAN.format(c='stop_name')} AS name, try_cast(stop_lat AS DOUBLE) AS lat, try_cast(stop_lon AS DOUBLE) AS lon FROM raw_stop",
    "stop_id", """CASE WHEN name = '' THEN 'stop without a name'
      WHEN lat IS NULL OR lon IS NULL OR NOT isfinite(lat) OR NOT isfinite(lon) OR abs(lat) > 90 OR abs(lon) > 180 OR (lat = 0 AND lon = 0) THEN 'invalid coordinates'
      WHEN lat < 6 OR lat > 38 OR lon < 68 OR lon > 98 THEN 'coordinates outside the supported region' END""",
    "CASE WHEN trim(stop_id) = '' THEN 'stop without an id' END", "trim(location_type) <> '' AND location_type <> '0'")
PARTS["f_route"] = judged(
    f"""SELECT r.*, {CLEAN.format(c='route_long_name')} AS long_name, {CLEAN.format(c='route_short_name')} AS short_name,
        try_cast(route_type AS INT) AS kind, r.agency_id IN (SELECT agency_id FROM f_agency WHERE outcome = 'accepted') AS has_agency FROM raw_route r""",
    "route_id", """CASE WHEN long_name = '' AND short_name = '' THEN 'route without a name'
      WHEN trim(agency_id) <> '' AND NOT has_agency THEN 'route of an unknown agency'
      WHEN kind IS NULL OR kind < 0 THEN 'invalid route type' END""", "CASE WHEN trim(route_id) = '' THEN 'route without an id' END")
PARTS["f_calendar"] = judged(
    f"SELECT *, {DAY.format(c='start_date')} AS start_day, {DAY.format(c='end_date')} AS end_day FROM raw_calendar",
    "service_id", "CASE WHEN start_day IS NULL OR end_day IS NULL THEN 'invalid service dates' WHEN end_day < start_day THEN 'service ends before it starts' WHEN "
    + " OR ".join(f"{d} NOT IN ('0','1')" for d in DAYS) + " THEN 'invalid service day flag' END",
    "CASE WHEN trim(service_id) = '' THEN 'service without an id' END")
PARTS["f_date"] = f"""
SELECT *, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome FROM (
 SELECT *, CASE WHEN service_date IS NULL OR trim(service_id) = '' OR exception_type NOT IN ('1','2') THEN 'invalid calendar date entry' END AS reason
 FROM (SELECT *, {DAY.format(c='date')} AS service_date, exception_type = '1' AS added FROM raw_calendar_date))"""
PARTS["f_point"] = judged(
    "SELECT *, try_cast(shape_pt_lat AS DOUBLE) AS lat, try_cast(shape_pt_lon AS DOUBLE) AS lon, try_cast(shape_pt_sequence AS INT) AS seq FROM raw_shape",
    "shape_id, seq", "CASE WHEN lat IS NULL OR lon IS NULL OR seq IS NULL OR seq < 0 OR lat < 6 OR lat > 38 OR lon < 68 OR lon > 98 THEN 'invalid shape point' END",
    "CASE WHEN trim(shape_id) = '' THEN 'shape point without a shape id' END", late=True)
PARTS["f_shape"] = f"""
SELECT shape_id, count(*) AS points, CASE WHEN count(*) < 2 THEN 'rejected' ELSE 'accepted' END AS outcome,
       CASE WHEN count(*) < 2 THEN 'shape with fewer than two points' END AS reason
FROM (SELECT *, lag((la, lo)) OVER (PARTITION BY shape_id ORDER BY seq) AS before
      FROM (SELECT *, {R6.format(c='lat')} AS la, {R6.format(c='lon')} AS lo FROM f_point WHERE outcome = 'accepted'))
WHERE before IS NULL OR before <> (la, lo) GROUP BY shape_id"""
PARTS["f_trip"] = judged(
    """SELECT r.*, r.route_id IN (SELECT route_id FROM f_route WHERE outcome = 'accepted') AS has_route,
        r.service_id IN (SELECT service_id FROM f_calendar WHERE outcome = 'accepted' UNION SELECT service_id FROM f_date WHERE outcome = 'accepted') AS has_service,
        r.shape_id IN (SELECT shape_id FROM f_shape WHERE outcome = 'accepted') AS has_shape FROM raw_trip r""",
    "trip_id", """CASE WHEN NOT has_route THEN 'trip of an unknown route' WHEN trim(service_id) = '' THEN 'trip without a service'
      WHEN NOT has_service THEN 'trip of an unknown service' END""", "CASE WHEN trim(trip_id) = '' THEN 'trip without an id' END")
PARTS["f_start"] = """
SELECT trip_id, row_pos, row_number() OVER (PARTITION BY trip_id ORDER BY row_pos) AS nth FROM (
 SELECT trip_id, row_pos, lag(trip_id) OVER (ORDER BY row_pos) AS before FROM raw_stop_time) x WHERE before IS NULL OR before <> trip_id"""
PARTS["f_stop_time"] = """
SELECT * EXCLUDE (outcome, reason), CASE WHEN reason = 'ignored' THEN 'ignored' ELSE outcome END AS outcome, NULLIF(reason, 'ignored') AS reason FROM (""" + judged(
    f"""SELECT r.*, {SEC.format(c='arrival_time')} AS arrival_s, {SEC.format(c='departure_time')} AS departure_s, try_cast(stop_sequence AS INT) AS seq,
        r.trip_id IN (SELECT trip_id FROM f_trip WHERE outcome = 'accepted') AS has_trip,
        r.stop_id IN (SELECT stop_id FROM f_stop WHERE outcome = 'accepted') AS has_stop, s.row_pos AS again_pos
        FROM raw_stop_time r LEFT JOIN f_start s ON s.trip_id = r.trip_id AND s.nth = 2""",
    "trip_id, seq", """CASE WHEN row_pos >= again_pos THEN 'ignored' WHEN NOT has_stop THEN 'stop time of an unknown stop' WHEN seq IS NULL OR seq < 0 THEN 'invalid stop sequence'
      WHEN (trim(arrival_time) <> '' AND arrival_s IS NULL) OR (trim(departure_time) <> '' AND departure_s IS NULL) THEN 'malformed stop time'
      WHEN departure_s < arrival_s THEN 'departure before arrival' END""",
    "CASE WHEN NOT has_trip THEN 'stop time of an unknown trip' END", late=True) + ")"
PARTS["f_flat"] = """
SELECT trip_id, seq, 0 AS k, arrival_s AS v FROM f_stop_time WHERE outcome = 'accepted' AND arrival_s IS NOT NULL
UNION ALL SELECT trip_id, seq, 1, departure_s FROM f_stop_time WHERE outcome = 'accepted' AND departure_s IS NOT NULL"""
PARTS["f_result"] = """
SELECT trip_id, rows, reason, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome FROM (
 SELECT t.trip_id, coalesce(g.rows, 0) AS rows, CASE WHEN s.trip_id IS NULL THEN 'trip without stop times'
   WHEN coalesce(g.rows, 0) < 2 THEN 'trip with fewer than two valid stop times' WHEN b.trip_id IS NOT NULL THEN 'trip with times going backwards' END AS reason
 FROM (SELECT trip_id FROM f_trip WHERE outcome = 'accepted') t
 LEFT JOIN (SELECT DISTINCT trip_id FROM f_stop_time WHERE outcome <> 'ignored') s ON s.trip_id = t.trip_id
 LEFT JOIN (SELECT trip_id, count(*) AS rows FROM f_stop_time WHERE outcome = 'accepted' GROUP BY trip_id) g ON g.trip_id = t.trip_id
 LEFT JOIN (SELECT DISTINCT trip_id FROM (SELECT trip_id, v, lag(v) OVER (PARTITION BY trip_id ORDER BY seq, k) AS p FROM f_flat) x WHERE v < p) b ON b.trip_id = t.trip_id)"""
PARTS["f_ok_time"] = """
SELECT s.* FROM f_stop_time s WHERE s.outcome = 'accepted' AND s.trip_id IN (SELECT trip_id FROM f_result WHERE outcome = 'accepted')"""


def feed(t) -> b.Import:
    t.keep("a_line")
    return b.Import(t.raw_agency, t.raw_stop, t.raw_route, t.raw_calendar, t.raw_calendar_date, t.raw_shape, t.raw_trip,
                    t.raw_stop_time)


@query("bi1_agencies", "SELECT row_pos, outcome, reason, name FROM f_agency")
def bi1(t):
    return b.agencies(t.raw_agency).select("row_pos", "outcome", "reason", "name")


@query("bi2_stops", f"""SELECT row_pos, outcome, reason, CASE WHEN outcome = 'accepted' THEN {R6.format(c='lat')} END AS lat,
  CASE WHEN outcome = 'accepted' THEN {R6.format(c='lon')} END AS lon,
  CASE wheelchair_boarding WHEN '1' THEN 'ACCESSIBLE' WHEN '2' THEN 'INACCESSIBLE' ELSE 'UNKNOWN' END AS access FROM f_stop""")
def bi2(t):
    ok = F.col("outcome") == "accepted"
    return b.stops(t.raw_stop).select("row_pos", "outcome", "reason", F.when(ok, F.col("lat")).alias("lat"),
                                      F.when(ok, F.col("lon")).alias("lon"), "access")


@query("bi3_routes", """SELECT row_pos, outcome, reason, long_name, short_name, kind,
  CASE WHEN regexp_full_match(route_color, '[0-9A-Fa-f]{6}') THEN concat('#', upper(route_color)) END AS color FROM f_route""")
def bi3(t):
    return (b.routes(t.raw_route, accepted(b.agencies(t.raw_agency)))
            .select("row_pos", "outcome", "reason", "long_name", "short_name", "kind", "color"))


@query("bi4_calendar", "SELECT row_pos, outcome, reason, CASE WHEN outcome = 'accepted' THEN concat_ws(',', "
       + ", ".join(f"CASE WHEN {d} = '1' THEN '{d}' END" for d in DAYS) + ") END AS days, start_day, end_day FROM f_calendar")
def bi4(t):
    return b.calendar(t.raw_calendar).select("row_pos", "outcome", "reason", F.when(F.col("outcome") == "accepted",
                                             F.array_join("days", ",")).alias("days"), "start_day", "end_day")


@query("bi5_calendar_dates", "SELECT row_pos, outcome, reason, service_date, added FROM f_date")
def bi5(t):
    return b.calendar_dates(t.raw_calendar_date).select("row_pos", "outcome", "reason", "service_date", "added")


@query("bi6_service_exceptions", """
SELECT service_id, service_date, arg_max(added, row_pos) AS added FROM f_date
WHERE outcome = 'accepted' AND service_id IN (SELECT service_id FROM f_calendar WHERE outcome = 'accepted') GROUP BY service_id, service_date""")
def bi6(t):
    return b.service_exceptions(accepted(b.calendar_dates(t.raw_calendar_date)), accepted(b.calendar(t.raw_calendar)))


@query("bi7_shape_points", "SELECT row_pos, outcome, reason FROM f_point")
def bi7(t):
    return b.shape_points(t.raw_shape).select("row_pos", "outcome", "reason")


@query("bi7_shapes", "SELECT shape_id, points, outcome, reason FROM f_shape")
def bi7_shapes(t):
    return b.shapes(t.raw_shape)


@query("bi8_trips", f"""SELECT row_pos, outcome, reason, NULLIF({CLEAN.format(c='trip_headsign')}, '') AS headsign,
 CASE direction_id WHEN '0' THEN 0 WHEN '1' THEN 1 END AS direction, CASE WHEN has_shape THEN shape_id END AS shape,
 trim(shape_id) <> '' AND NOT has_shape AS shape_cleared FROM f_trip""")
def bi8(t):
    return feed(t).trips.select("row_pos", "outcome", "reason", "headsign", "direction", "shape", "shape_cleared")


@query("bi9_stop_time_rows", "SELECT row_pos, outcome, reason, seq, arrival_s, departure_s FROM f_stop_time")
def bi9(t):
    return feed(t).stop_times.select("row_pos", "outcome", "reason", "seq", "arrival_s", "departure_s")


@query("bi10_trip_runs", """
SELECT trip_id, min(row_pos) AS first_pos, min(CASE WHEN nth = 2 THEN row_pos END) AS again_pos, NULLIF(count(*) - 1, 0) AS reappearances
FROM f_start GROUP BY trip_id""")
def bi10(t):
    return b.trip_runs(t.raw_stop_time)


@query("bi11_trip_results", "SELECT trip_id, rows, reason, outcome FROM f_result")
def bi11(t):
    return feed(t).results


@query("bi12_accepted_trips", """
SELECT trip_id, route_id FROM f_trip WHERE outcome = 'accepted' AND trip_id IN (SELECT trip_id FROM f_result WHERE outcome = 'accepted')""")
def bi12(t):
    return feed(t).accepted_trips().select("trip_id", "route_id")


@query("bi12_accepted_stop_times", "SELECT trip_id, seq, stop_id FROM f_ok_time")
def bi12_times(t):
    return feed(t).accepted_stop_times().select("trip_id", "seq", "stop_id")


@query("bi14_usage", """
SELECT 'trips with headsign' AS what, count(*) AS n FROM f_trip WHERE outcome = 'accepted' AND trim(trip_headsign) <> ''
UNION ALL SELECT 'trips with direction', count(*) FROM f_trip WHERE outcome = 'accepted' AND direction_id IN ('0', '1')
UNION ALL SELECT 'trips without shape', count(*) FROM f_trip WHERE outcome = 'accepted' AND NOT has_shape
UNION ALL SELECT 'shape references cleared', count(*) FROM f_trip WHERE outcome = 'accepted' AND trim(shape_id) <> '' AND NOT has_shape
UNION ALL SELECT 'routes without trips', count(*) FROM f_route WHERE outcome = 'accepted' AND route_id NOT IN (SELECT route_id FROM f_trip WHERE outcome = 'accepted')
UNION ALL SELECT 'unused stops', count(*) FROM f_stop WHERE outcome = 'accepted' AND stop_id NOT IN (SELECT stop_id FROM f_ok_time)""")
def bi14(t):
    return feed(t).usage()


@query("bi15_service_period", """
SELECT min(start_day) AS first_day, max(end_day) AS last_day, concat_ws(',', """ + ", ".join(
    f"CASE WHEN bool_or({d} = '1') THEN '{d}' END" for d in DAYS) + """) AS days
FROM f_calendar WHERE outcome = 'accepted' AND service_id IN (SELECT service_id FROM f_trip WHERE outcome = 'accepted')""")
def bi15(t):
    return feed(t).service_period()


@query("bi16_statistics", " UNION ALL ".join(
    f"SELECT '{n}' AS tbl, outcome, coalesce(reason, '') AS reason, count(*) AS n FROM {p} GROUP BY outcome, reason" for n, p in (
        ("agency", "f_agency"), ("stops", "f_stop"), ("routes", "f_route"), ("calendar", "f_calendar"), ("calendar_dates", "f_date"),
        ("shape_points", "f_point"), ("shapes", "f_shape"), ("trips", "f_trip"), ("stop_times", "f_stop_time"), ("trip_results", "f_result")))
    + """ UNION ALL SELECT 'trip_runs', 'rejected', 'stop times of a trip are not contiguous', count(*) FROM f_start
 WHERE nth > 1 AND trip_id IN (SELECT trip_id FROM f_trip WHERE outcome = 'accepted')""")
def bi16(t):
    return feed(t).statistics()
