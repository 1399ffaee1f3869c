"""Timetable relations and bus journeys for the whole request table."""

from pyspark.sql import functions as F

from wayline.catalog.patterns import layer
from wayline.operators import nearby as nb
from wayline.operators.stage import stage
from wayline.plans import bus_plan as b, patterns as p, timetable as tt
from wayline.registry import PARTS, query

HAV = ("(2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) "
       "* pow(sin(radians({d} - {c}) / 2), 2)))) + 0 * ({a} + {b} + {c} + {d}))")  # a, b latitudes; c, d longitudes


def hav(lat1, lon1, lat2, lon2):
    return HAV.format(a=lat1, b=lat2, c=lon1, d=lon2)


def half(x):
    return f"CAST(floor({x} + 0.5e0) AS BIGINT)"


def walk(m):
    return half(f"({m}) * 1.3e0 / 1.25e0")


WEIGHT = "CASE WHEN preference = 'LESS_WALKING' THEN 3e0 ELSE 1.5e0 END"
PARTS["n_exc"] = """
SELECT s.service_id, r.service_date AS day, arg_max(r.added, r.row_pos) AS added FROM a_service_date_raw r JOIN a_service s ON s.d = r.d
GROUP BY s.service_id, r.service_date"""
PARTS["n_day"] = "SELECT DISTINCT day FROM a_request"
PARTS["n_day2"] = "SELECT day FROM n_day UNION SELECT CAST(day - INTERVAL 1 DAY AS DATE) FROM n_day"
PARTS["n_running"] = """
SELECT d.day, s.service_id FROM n_day2 d JOIN a_service s ON true
WHERE (s.start_date <= d.day AND s.end_date >= d.day AND contains(s.days, concat(',', lower(dayname(d.day)), ','))
  AND NOT EXISTS (SELECT 1 FROM n_exc e WHERE e.service_id = s.service_id AND e.day = d.day AND NOT e.added))
 OR EXISTS (SELECT 1 FROM n_exc e WHERE e.service_id = s.service_id AND e.day = d.day AND e.added)"""
PARTS["n_usable"] = """
SELECT p.* FROM o_pattern p JOIN a_route r ON r.route_id = p.route_id AND r.active
WHERE NOT EXISTS (SELECT 1 FROM o_pattern_stop ps JOIN a_stop s ON s.stop_id = ps.stop_id WHERE ps.pattern_id = p.pattern_id AND NOT s.active)"""
PARTS["n_trip"] = "SELECT * FROM o_trip_pattern WHERE pattern_id IS NOT NULL"
PARTS["n_active"] = """
SELECT DISTINCT r.day, t.pattern_id FROM n_running r JOIN n_day d ON d.day = r.day JOIN n_trip t ON t.service_id = r.service_id
JOIN n_usable u ON u.pattern_id = t.pattern_id"""
PARTS["n_call"] = """
SELECT s.pattern_id, s.route_id, s.idx, s.stop_id, s.offset_s, CASE WHEN p.trip_count >= 2 AND p.last_departure > p.first_departure
  THEN CAST(trunc(greatest(120, least(900, (p.last_departure - p.first_departure) / (p.trip_count - 1) / 2))) AS BIGINT) ELSE 900 END AS wait_s
FROM o_pattern_stop s JOIN o_pattern p ON p.pattern_id = s.pattern_id"""
PARTS["n_serving"] = """
SELECT a.day, c.stop_id, count(DISTINCT c.pattern_id) AS serving FROM n_call c JOIN n_active a ON a.pattern_id = c.pattern_id GROUP BY a.day, c.stop_id"""
PARTS["n_foot"] = f"""
SELECT * FROM (SELECT a.stop_id AS from_id, b.stop_id, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS meters FROM a_stop a JOIN a_stop b ON a.stop_id <> b.stop_id
 AND a.active AND b.active AND abs(a.lat - b.lat) < 0.004 AND abs(a.lon - b.lon) < 0.006) x WHERE meters <= 300"""
for side in ("from", "to"):
    PARTS[f"n_near_{side}"] = f"""
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY meters, stop_id) AS rank FROM (
 SELECT r.request_id, r.day, s.stop_id, {hav(f'r.{side}_lat', f'r.{side}_lon', 's.lat', 's.lon')} AS meters FROM a_request r
 JOIN a_stop s ON s.active AND abs(s.lat - r.{side}_lat) < 0.02 AND abs(s.lon - r.{side}_lon) < 0.02) x WHERE meters <= 1500"""
    PARTS[f"n_{side}"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score, meters, stop_id) AS place FROM (
 SELECT n.request_id, n.stop_id, n.meters, {walk('n.meters')} AS walk_s, s.serving, {walk('n.meters')} + greatest(0, 300 - 60 * least(s.serving, 5)) AS score,
   CASE WHEN n.meters <= 600 THEN 0 ELSE 1 END AS tier, min(CASE WHEN n.meters <= 600 THEN 0 ELSE 1 END) OVER (PARTITION BY n.request_id) AS best_tier
 FROM n_near_{side} n JOIN n_serving s ON s.day = n.day AND s.stop_id = n.stop_id WHERE n.rank <= 60) x WHERE tier = best_tier) y WHERE place <= 8"""
PARTS["n_req"] = f"SELECT *, CASE WHEN preference = 'FEWER_TRANSFERS' THEN 900 ELSE 180 END AS penalty, {WEIGHT} AS weight FROM a_request"
PARTS["n_pos"] = "SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence) - 1 AS idx FROM a_stop_time"
PARTS["n_run"] = """
SELECT r.day, t.pattern_id, p.idx AS board_idx, coalesce(p.departure_s, p.arrival_s) AS eff_s, 0 AS shift, t.trip_id
FROM n_pos p JOIN n_trip t ON t.trip_id = p.trip_id JOIN n_running r ON r.service_id = t.service_id WHERE coalesce(p.departure_s, p.arrival_s) IS NOT NULL
UNION ALL
SELECT CAST(r.day + INTERVAL 1 DAY AS DATE), t.pattern_id, p.idx, coalesce(p.departure_s, p.arrival_s) - 86400, -86400, t.trip_id
FROM n_pos p JOIN n_trip t ON t.trip_id = p.trip_id JOIN n_running r ON r.service_id = t.service_id WHERE coalesce(p.departure_s, p.arrival_s) IS NOT NULL"""


def next_run(wanted: str, key: str) -> str:
    return f"""SELECT {key}, min(r.eff_s) AS board_s, arg_min(r.trip_id, (r.eff_s, r.trip_id)) AS trip_id, arg_min(r.shift, (r.eff_s, r.trip_id)) AS shift
FROM {wanted} w JOIN n_run r ON r.day = w.day AND r.pattern_id = w.pattern_id AND r.board_idx = w.board_idx AND r.eff_s BETWEEN w.ready_s AND w.ready_s + 5400
GROUP BY {key}"""


def attempt_parts(n: int) -> None:
    """The search rounds and the schedule of one attempt, as named sub-queries."""
    ban = "" if n == 0 else f" AND NOT EXISTS (SELECT 1 FROM z{n - 1}_ban x WHERE x.request_id = m.request_id AND x.route_id = c.route_id)"
    only = "" if n == 0 else f" WHERE request_id IN (SELECT request_id FROM z{n - 1}_last)"
    z = f"z{n}"
    PARTS[f"{z}_req"] = f"SELECT * FROM n_req{only}"
    PARTS[f"{z}_s0"] = f"""
SELECT a.request_id, a.stop_id, min({half('a.walk_s * r.weight')}) AS cost, CAST(-1 AS BIGINT) AS via_route, false AS by_ride,
 CAST([] AS STRUCT(pattern_id VARCHAR, route_id BIGINT, board_idx BIGINT, alight_idx BIGINT, board_stop BIGINT, alight_stop BIGINT)[]) AS legs
FROM n_from a JOIN {z}_req r ON r.request_id = a.request_id GROUP BY a.request_id, a.stop_id"""
    PARTS[f"{z}_m0"] = f"SELECT * FROM {z}_s0"
    PARTS[f"{z}_t0"] = "SELECT CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BIGINT) AS best_total, CAST(NULL AS BIGINT) AS best_legs WHERE false"
    for k in (1, 2, 3):
        q = k - 1
        PARTS[f"{z}_b{k}"] = f"""
SELECT m.request_id, c.pattern_id, c.route_id, c.idx, c.stop_id, m.legs, m.cost + c.wait_s + r.penalty - c.offset_s AS base
FROM {z}_m{q} m JOIN {z}_req r ON r.request_id = m.request_id JOIN n_call c ON c.stop_id = m.stop_id JOIN n_active a ON a.day = r.day AND a.pattern_id = c.pattern_id
WHERE m.via_route <> c.route_id{ban}"""
        PARTS[f"{z}_a{k}"] = f"""
SELECT request_id, stop_id, base + offset_s AS cost, pattern_id, idx, route_id AS via_route,
 list_concat(legs, [{{'pattern_id': pattern_id, 'route_id': route_id, 'board_idx': bidx, 'alight_idx': idx, 'board_stop': bstop, 'alight_stop': stop_id}}]) AS legs FROM (
 SELECT b.request_id, c.pattern_id, c.route_id, c.idx, c.stop_id, c.offset_s, min(b.base) AS base, arg_min(b.idx, (b.base, b.idx)) AS bidx,
   arg_min(b.stop_id, (b.base, b.idx)) AS bstop, arg_min(b.legs, (b.base, b.idx)) AS legs
 FROM {z}_b{k} b JOIN n_call c ON c.pattern_id = b.pattern_id AND c.idx > b.idx GROUP BY b.request_id, c.pattern_id, c.route_id, c.idx, c.stop_id, c.offset_s) x"""
        better = "(s.cost IS NULL OR x.cost < s.cost) AND (t.best_total IS NULL OR x.cost < t.best_total)"
        PARTS[f"{z}_r{k}"] = f"""
SELECT x.*, true AS by_ride FROM (SELECT request_id, stop_id, min(cost) AS cost, arg_min(via_route, (cost, pattern_id, idx)) AS via_route, arg_min(legs, (cost, pattern_id, idx)) AS legs
 FROM {z}_a{k} GROUP BY request_id, stop_id) x LEFT JOIN {z}_s{q} s ON s.request_id = x.request_id AND s.stop_id = x.stop_id
LEFT JOIN {z}_t{q} t ON t.request_id = x.request_id WHERE {better}"""
        merge = ("SELECT request_id, stop_id, min(cost) AS cost, arg_min(via_route, cost) AS via_route, arg_min(by_ride, cost) AS by_ride, arg_min(legs, cost) AS legs FROM "
                 "(SELECT request_id, stop_id, cost, via_route, by_ride, legs FROM {a} UNION ALL SELECT request_id, stop_id, cost, via_route, by_ride, legs FROM {b}) u GROUP BY request_id, stop_id")
        PARTS[f"{z}_k{k}"] = merge.format(a=f"{z}_s{q}", b=f"{z}_r{k}")
        PARTS[f"{z}_w{k}"] = f"""
SELECT x.*, false AS by_ride FROM (SELECT request_id, stop_id, min(cost) AS cost, arg_min(via_route, (cost, from_id)) AS via_route, arg_min(legs, (cost, from_id)) AS legs FROM (
  SELECT m.request_id, f.stop_id, m.cost + {half(walk('f.meters') + ' * r.weight')} AS cost, f.from_id, m.via_route, m.legs
  FROM {z}_r{k} m JOIN n_foot f ON f.from_id = m.stop_id JOIN {z}_req r ON r.request_id = m.request_id) y GROUP BY request_id, stop_id) x
LEFT JOIN {z}_k{k} s ON s.request_id = x.request_id AND s.stop_id = x.stop_id LEFT JOIN {z}_t{q} t ON t.request_id = x.request_id WHERE {better}"""
        PARTS[f"{z}_m{k}"] = merge.format(a=f"{z}_r{k}", b=f"{z}_w{k}")
        PARTS[f"{z}_s{k}"] = merge.format(a=f"{z}_s{q}", b=f"{z}_m{k}")
        PARTS[f"{z}_p{k}"] = f"""
SELECT x.*, {k} AS round FROM (SELECT s.request_id, min(s.cost + {half('e.walk_s * r.weight')}) AS total, arg_min(s.stop_id, (s.cost + {half('e.walk_s * r.weight')}, s.stop_id)) AS egress_stop,
  arg_min(e.walk_s, (s.cost + {half('e.walk_s * r.weight')}, s.stop_id)) AS egress_walk_s, arg_min(s.legs, (s.cost + {half('e.walk_s * r.weight')}, s.stop_id)) AS legs
 FROM {z}_s{k} s JOIN n_to e ON e.request_id = s.request_id AND e.stop_id = s.stop_id JOIN {z}_req r ON r.request_id = s.request_id WHERE s.by_ride GROUP BY s.request_id) x
LEFT JOIN {z}_t{q} t ON t.request_id = x.request_id WHERE t.best_total IS NULL OR (x.total + 120 < t.best_total AND len(x.legs) > t.best_legs)"""
        PARTS[f"{z}_t{k}"] = f"""
SELECT request_id, total AS best_total, len(legs) AS best_legs FROM {z}_p{k} UNION ALL SELECT * FROM {z}_t{q} WHERE request_id NOT IN (SELECT request_id FROM {z}_p{k})"""
    PARTS[f"{z}_plan"] = f"""
SELECT p.*, a.walk_s AS access_walk_s FROM (SELECT * FROM {z}_p1 UNION ALL SELECT * FROM {z}_p2 UNION ALL SELECT * FROM {z}_p3) p
JOIN (SELECT request_id, stop_id, min(walk_s) AS walk_s FROM n_from GROUP BY request_id, stop_id) a ON a.request_id = p.request_id AND a.stop_id = p.legs[1].board_stop"""
    for i in (0, 1, 2):
        if i == 0:
            ready = f"SELECT p.request_id, p.round, p.legs, r.day, r.depart_s + p.access_walk_s AS ready_s FROM {z}_plan p JOIN n_req r ON r.request_id = p.request_id"
        else:
            ready = f"""SELECT p.request_id, p.round, p.legs, p.day, p.alight_s + CASE WHEN p.legs[{i}].alight_stop = p.legs[{i + 1}].board_stop THEN 0
 ELSE {walk(hav('a.lat', 'a.lon', 'b.lat', 'b.lon'))} END + 60 AS ready_s FROM {z}_l{i - 1} p JOIN a_stop a ON a.stop_id = p.legs[{i}].alight_stop
 JOIN a_stop b ON b.stop_id = p.legs[{i + 1}].board_stop WHERE len(p.legs) > {i}"""
        PARTS[f"{z}_q{i}"] = f"SELECT *, legs[{i + 1}].pattern_id AS pattern_id, legs[{i + 1}].board_idx AS board_idx FROM ({ready}) x"
        PARTS[f"{z}_n{i}"] = next_run(f"{z}_q{i}", "w.request_id, w.round")
        PARTS[f"{z}_l{i}"] = f"""
SELECT w.request_id, w.round, {i} AS leg, w.legs, w.day, w.ready_s, n.board_s, n.trip_id, coalesce(e.arrival_s, e.departure_s) + n.shift AS alight_s, n.board_s - w.ready_s AS wait_s
FROM {z}_q{i} w JOIN {z}_n{i} n ON n.request_id = w.request_id AND n.round = w.round
JOIN n_pos e ON e.trip_id = n.trip_id AND e.idx = w.legs[{i + 1}].alight_idx WHERE coalesce(e.arrival_s, e.departure_s) + n.shift >= n.board_s"""
    PARTS[f"{z}_ride"] = f"""
SELECT request_id, round, leg, trip_id, board_s, alight_s, wait_s, l.pattern_id, l.route_id, l.board_idx, l.alight_idx, l.board_stop, l.alight_stop FROM (
 SELECT *, legs[leg + 1] AS l, len(legs) AS need, count(*) OVER (PARTITION BY request_id, round) AS have
 FROM (SELECT * FROM {z}_l0 UNION ALL SELECT * FROM {z}_l1 UNION ALL SELECT * FROM {z}_l2) u) x WHERE need = have"""
    PARTS[f"{z}_walked"] = f"""
SELECT x.*, coalesce(prev_route = route_id AND prev_stop = board_stop, false) AS continues, coalesce(prev_route <> route_id, false) AS transfer,
 CASE WHEN prev_stop <> board_stop THEN {half(hav('a.lat', 'a.lon', 'b.lat', 'b.lon') + ' * 1.3e0')} ELSE 0 END AS change_m,
 CASE WHEN prev_stop <> board_stop THEN {walk(hav('a.lat', 'a.lon', 'b.lat', 'b.lon'))} ELSE 0 END AS change_s
FROM (SELECT *, lag(route_id) OVER w AS prev_route, lag(alight_stop) OVER w AS prev_stop, lead(route_id) OVER w AS next_route FROM {z}_ride WINDOW w AS (PARTITION BY request_id, round ORDER BY leg)) x
LEFT JOIN a_stop a ON a.stop_id = x.prev_stop JOIN a_stop b ON b.stop_id = x.board_stop"""
    PARTS[f"{z}_part"] = f"""
SELECT *, sum(CASE WHEN continues THEN 0 ELSE 1 END) OVER (PARTITION BY request_id, round ORDER BY leg) AS part FROM {z}_walked"""
    PARTS[f"{z}_key"] = f"""
SELECT request_id, round, string_agg(k, '' ORDER BY part) AS ride_key FROM (SELECT request_id, round, part,
  concat(CAST(arg_min(route_id, leg) AS VARCHAR), '@', CAST(arg_min(board_stop, leg) AS VARCHAR), '>', CAST(arg_max(alight_stop, leg) AS VARCHAR), ';') AS k
 FROM {z}_part GROUP BY request_id, round, part) x GROUP BY request_id, round"""
    PARTS[f"{z}_journey"] = f"""
SELECT g.request_id, g.round, g.transfers, g.bus_legs, g.ride_s, g.wait_s, g.hops, g.first_route, k.ride_key, p.access_walk_s + p.egress_walk_s + g.change_s AS walking_s,
 {half(hav('r.from_lat', 'r.from_lon', 'f.lat', 'f.lon') + ' * 1.3e0')} + {half(hav('t.lat', 't.lon', 'r.to_lat', 'r.to_lon') + ' * 1.3e0')} + g.change_m AS walking_m,
 g.last_s + p.egress_walk_s AS arrive_s, greatest(0, g.last_s + p.egress_walk_s - r.depart_s) AS duration_s, {n} AS attempt
FROM (SELECT request_id, round, count(*) FILTER (WHERE transfer) AS transfers, count(*) FILTER (WHERE NOT continues) AS bus_legs, CAST(sum(alight_s - board_s) AS BIGINT) AS ride_s,
  CAST(sum(wait_s) AS BIGINT) AS wait_s, CAST(sum(alight_idx - board_idx) AS BIGINT) AS hops, CAST(sum(change_s) AS BIGINT) AS change_s, CAST(sum(change_m) AS BIGINT) AS change_m, arg_max(alight_s, leg) AS last_s,
  arg_min(board_stop, leg) AS first_stop, arg_max(alight_stop, leg) AS last_stop, arg_min(route_id, leg) AS first_route FROM {z}_walked GROUP BY request_id, round) g
JOIN {z}_key k ON k.request_id = g.request_id AND k.round = g.round JOIN {z}_plan p ON p.request_id = g.request_id AND p.round = g.round
JOIN n_req r ON r.request_id = g.request_id JOIN a_stop f ON f.stop_id = g.first_stop JOIN a_stop t ON t.stop_id = g.last_stop"""
    PARTS[f"{z}_last"] = f"""
SELECT p.request_id, coalesce(arg_min(j.first_route, j.round), arg_min(p.legs[1].route_id, p.round)) AS route_id FROM {z}_plan p
LEFT JOIN {z}_journey j ON j.request_id = p.request_id AND j.round = p.round GROUP BY p.request_id"""
    PARTS[f"{z}_ban"] = f"SELECT * FROM {z}_last" + (f" UNION ALL SELECT * FROM z{n - 1}_ban" if n else "")


for _n in range(3):
    attempt_parts(_n)
PARTS["z_all"] = " UNION ALL ".join(f"SELECT * FROM z{n}_journey" for n in range(3))
PARTS["z_place"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY arrive_s, transfers, walking_s, attempt, round) AS place FROM (
 SELECT *, row_number() OVER (PARTITION BY request_id, ride_key ORDER BY attempt, round) AS copy FROM z_all) x WHERE copy = 1) y WHERE place <= 3"""


def network(t) -> b.Network:
    t.keep("a_stop_time")
    return b.Network(layer(t), t.a_stop, t.a_route, t.a_service, tt.last_exceptions(t.a_service_date_raw, t.a_service),
                     t.a_request.select("day").distinct(), stage(p.timed_positions(t.a_stop_time)))


def planned(t):
    net = network(t)
    req = stage(b.settings(t.a_request))
    access, egress = b.request_stops(req, net, b.CANDIDATES, b.ACCESS_STOPS)
    return net, req, access, egress


def scheduled(t):
    net, req, access, egress = planned(t)
    plans = b.search(req, access, egress, net, rounds=b.ROUNDS)
    return net, req, plans, b.resolve(plans, req, net, net._positions)


r3 = lambda c: F.round(c, 3).alias(c)


@query("jn6_footpaths", "SELECT from_id, stop_id, round(meters, 3) AS meters FROM n_foot")
def jn6(t):
    return nb.footpaths(t.a_stop.filter("active"), 300).select("from_id", "stop_id", r3("meters"))


@query("jn5_nearest_stops", "SELECT request_id, stop_id, round(meters, 3) AS meters, rank FROM n_near_from")
def jn5(t):
    pts = t.a_request.select("request_id", F.col("from_lat").alias("plat"), F.col("from_lon").alias("plon"))
    return (nb.nearest(pts, "request_id", t.a_stop.filter("active").select("stop_id", "lat", "lon"), 1500)
            .select("request_id", "stop_id", r3("meters"), "rank"))


_WIN = """CASE WHEN NOT coalesce(abs(south) <= 90 AND abs(north) <= 90 AND abs(west) <= 180 AND abs(east) <= 180 AND north > south AND east > west, false) THEN 'invalid window'
 WHEN north - south > 4e-2 OR east - west > 4e-2 THEN 'window too large' END"""


@query("val3_windows", f"SELECT window_id, {_WIN} AS reason FROM a_window")
def val3(t):
    return t.a_window.select("window_id", nb.window_reason().alias("reason"))


@query("jn7_window_stops", f"""
SELECT w.window_id, s.stop_id, row_number() OVER (PARTITION BY w.window_id ORDER BY s.stop_name, s.stop_id) AS place FROM a_window w JOIN a_stop s ON s.lat BETWEEN w.south AND w.north AND s.lon BETWEEN w.west AND w.east
 WHERE s.active AND {_WIN} IS NULL AND s.stop_id IN (SELECT stop_id FROM o_pattern_stop)""")
def jn7(t):
    served = t.a_stop.filter("active").join(layer(t).stops, "stop_id", "left_semi")
    return nb.window_stops(t.a_window, served)


@query("jn8_services_on", "SELECT day, service_id FROM n_running")
def jn8(t):
    return network(t).running


@query("jn9_active_patterns", "SELECT DISTINCT r.day, t.pattern_id FROM n_running r JOIN n_trip t ON t.service_id = r.service_id")
def jn9(t):
    net = network(t)
    return tt.active_patterns(net.running, net._layer.trips)


PARTS["n_wanted"] = """
SELECT r.request_id, r.day, r.depart_s AS ready_s, c.pattern_id, c.idx AS board_idx FROM a_request r JOIN n_call c ON c.stop_id = r.request_id % (SELECT count(*) FROM supplier)"""


@query("jn10_next_departure", next_run("n_wanted", "w.request_id, w.pattern_id, w.board_idx"))
def jn10(t):
    net = network(t)
    calls = net.calls.select("pattern_id", F.col("idx").alias("board_idx"), "stop_id")
    stops = t.a_stop.agg(F.count(F.lit(1)).alias("n")).first().n
    wanted = (t.a_request.select("request_id", "day", F.col("depart_s").alias("ready_s"), (F.col("request_id") % stops).alias("stop_id"))
              .join(calls, "stop_id"))
    return tt.next_departure(wanted, ["request_id", "pattern_id", "board_idx"], net.departures, net.running)


@query("bj3_access_stops", "SELECT request_id, stop_id, round(meters, 3) AS meters, walk_s, serving, score, place AS rank FROM n_from")
def bj3(t):
    return planned(t)[2].select("request_id", "stop_id", r3("meters"), "walk_s", "serving", "score", "rank")


@query("bj3_egress_stops", "SELECT request_id, stop_id, round(meters, 3) AS meters, walk_s, serving, score, place AS rank FROM n_to")
def bj3_egress(t):
    return planned(t)[3].select("request_id", "stop_id", r3("meters"), "walk_s", "serving", "score", "rank")


@query("bj18_nearby", f"SELECT request_id, stop_id, {half('meters')} AS distance_m, serving FROM n_to")
def bj18(t):
    net = network(t)
    pts = t.a_request.select("request_id", "day", F.col("to_lat").alias("plat"), F.col("to_lon").alias("plon"))
    return b.nearby_stops(pts, "request_id", net.stops, net.serving).select(
        "request_id", "stop_id", F.floor(F.col("meters") + 0.5).alias("distance_m"), "serving")


@query("bj2_settings", "SELECT request_id, CAST(penalty AS BIGINT) AS penalty, weight FROM n_req")
def bj2(t):
    return b.settings(t.a_request).select("request_id", "penalty", "weight")


@query("bj4_start_costs", "SELECT request_id, stop_id, cost FROM z0_s0")
def bj4(t):
    _, req, access, _ = planned(t)
    return b.start_state(req, access).select("request_id", "stop_id", "cost")


@query("bj5_boardings", "SELECT request_id, pattern_id, min(idx) AS from_idx FROM z0_b1 GROUP BY request_id, pattern_id")
def bj5(t):
    net, req, access, _ = planned(t)
    return (b.boardings(stage(b.start_state(req, access)), req, net, None).groupBy("request_id", "pattern_id")
            .agg(F.min("idx").alias("from_idx")))


@query("wn7_best_boarding", "SELECT request_id, pattern_id, idx, cost, legs[1].board_idx AS board_idx FROM z0_a1")
def wn7(t):
    net, req, access, _ = planned(t)
    boards = stage(b.boardings(stage(b.start_state(req, access)), req, net, None))
    return b.ride_arrivals(boards, net).select("request_id", "pattern_id", "idx", "cost", F.col("legs")[0]["board_idx"].alias("board_idx"))


@query("bj6_bj7_first_round", "SELECT request_id, stop_id, cost, via_route, by_ride FROM z0_m1")
def bj6(t):
    net, req, access, _ = planned(t)
    state = stage(b.start_state(req, access))
    none = t.spark.createDataFrame([], "request_id bigint, best_total bigint, best_legs int")
    return b.round_step(state, state, none, req, net)[1].drop("legs")


@query("bj8_bj9_plans", """
SELECT request_id, round, total, egress_stop, egress_walk_s, access_walk_s, len(legs) AS rides, array_to_string(list_transform(legs, lambda x: concat(x.pattern_id, ':', CAST(x.board_idx AS VARCHAR), '-', CAST(x.alight_idx AS VARCHAR))), ',') AS legs
FROM (SELECT * REPLACE (CAST(round AS BIGINT) AS round) FROM z0_plan)""")
def bj8(t):
    net, req, access, egress = planned(t)
    leg = lambda x: F.concat(x["pattern_id"], F.lit(":"), x["board_idx"].cast("string"), F.lit("-"), x["alight_idx"].cast("string"))
    return b.search(req, access, egress, net, rounds=b.ROUNDS).select("request_id", "round", "total", "egress_stop", "egress_walk_s", "access_walk_s",
                                                     F.size("legs").alias("rides"), F.array_join(F.transform("legs", leg), ",").alias("legs"))


@query("bj11_scheduled_rides", "SELECT request_id, CAST(round AS BIGINT) AS round, CAST(leg AS BIGINT) AS leg, trip_id, board_s, alight_s, wait_s FROM z0_ride")
def bj11(t):
    return scheduled(t)[3].select("request_id", "round", "leg", "trip_id", "board_s", "alight_s", "wait_s")


@query("jn11_trip_matches_pattern", """
SELECT r.request_id, CAST(r.round AS BIGINT) AS round, CAST(r.leg AS BIGINT) AS leg, count(*) AS stops, bool_and(p.stop_id = c.stop_id) AS matches FROM z0_ride r JOIN n_pos p ON p.trip_id = r.trip_id
LEFT JOIN n_call c ON c.pattern_id = r.pattern_id AND c.idx = p.idx GROUP BY ALL""")
def jn11(t):
    net, _, _, rides = scheduled(t)
    pos = net._positions.select("trip_id", "idx", F.col("stop_id").alias("trip_stop"))
    calls = net.calls.select("pattern_id", "idx", "stop_id")
    return (rides.join(pos, "trip_id").join(calls, ["pattern_id", "idx"], "left").groupBy("request_id", "round", "leg")
            .agg(F.count(F.lit(1)).alias("stops"), F.bool_and(F.col("trip_stop") == F.col("stop_id")).alias("matches")))


@query("jn24_ride_stops", """
SELECT r.request_id, CAST(r.round AS BIGINT) AS round, CAST(r.leg AS BIGINT) AS leg, p.idx, p.stop_id FROM z0_ride r JOIN n_pos p ON p.trip_id = r.trip_id AND p.idx BETWEEN r.board_idx AND r.alight_idx""")
def jn24(t):
    net, _, _, rides = scheduled(t)
    return (rides.join(net._positions.select("trip_id", "idx", "stop_id"), "trip_id").filter("idx between board_idx and alight_idx")
            .select("request_id", "round", "leg", "idx", "stop_id"))


_J = "transfers, bus_legs, ride_s, wait_s, hops, first_route, ride_key, walking_s, walking_m, arrive_s, duration_s"


@query("ag16_journey_totals", f"SELECT request_id, CAST(round AS BIGINT) AS round, {_J} FROM z0_journey")
def ag16(t):
    net, req, plans, rides = scheduled(t)
    return b.journeys(rides, plans, req, net)


@query("bj14_segments", """
SELECT request_id, CAST(round AS BIGINT) AS round, row_number() OVER (PARTITION BY request_id, round ORDER BY o) AS ord, kind, route_id, from_stop, to_stop, seconds FROM (
 SELECT request_id, round, part * 2 AS o, 'BUS' AS kind, arg_min(route_id, leg) AS route_id, arg_min(board_stop, leg) AS from_stop, arg_max(alight_stop, leg) AS to_stop, max(alight_s) - min(board_s) AS seconds
 FROM z0_part GROUP BY request_id, round, part
 UNION ALL SELECT request_id, round, part * 2 - 1, CASE WHEN transfer THEN 'TRANSFER' ELSE 'WALK' END, NULL, prev_stop, board_stop, change_s FROM z0_part WHERE part > 1 AND NOT continues AND (transfer OR change_m > 0)
 UNION ALL SELECT p.request_id, p.round, 0, 'WALK', NULL, NULL, p.legs[1].board_stop, p.access_walk_s FROM z0_plan p WHERE (p.request_id, p.round) IN (SELECT (request_id, round) FROM z0_journey)
 UNION ALL SELECT p.request_id, p.round, 1000, 'WALK', NULL, p.legs[len(p.legs)].alight_stop, NULL, p.egress_walk_s FROM z0_plan p WHERE (p.request_id, p.round) IN (SELECT (request_id, round) FROM z0_journey)) x""")
def bj14(t):
    net, _, plans, rides = scheduled(t)
    return b.segments(rides, plans, net.stops)


@query("bj15_stop_list", """
SELECT request_id, CAST(round AS BIGINT) AS round, place, stop_id, CASE WHEN place = 1 THEN 'BOARDING' WHEN place = n THEN 'EXIT' WHEN (idx = alight_idx AND next_route <> route_id) OR (idx = board_idx AND transfer) THEN 'TRANSFER' ELSE 'INTERMEDIATE' END AS role FROM (
 SELECT w.*, p.idx, p.stop_id, row_number() OVER (PARTITION BY w.request_id, w.round ORDER BY w.leg, p.idx) AS place, count(*) OVER (PARTITION BY w.request_id, w.round) AS n
 FROM z0_walked w JOIN n_pos p ON p.trip_id = w.trip_id AND p.idx BETWEEN w.board_idx AND w.alight_idx WHERE NOT (p.idx = w.board_idx AND coalesce(w.prev_stop = p.stop_id, false))) x""")
def bj15(t):
    net, _, _, rides = scheduled(t)
    return b.stop_list(rides, net._positions)


@query("bj16_headsigns", """
SELECT r.request_id, CAST(r.round AS BIGINT) AS round, CAST(r.leg AS BIGINT) AS leg, coalesce(t.headsign, s.stop_name) AS headsign, CASE WHEN t.headsign IS NOT NULL THEN 'TRIP' ELSE 'TERMINAL_STOP' END AS headsign_source,
 coalesce(t.direction_id, p.direction_id) AS direction_id FROM z0_ride r JOIN a_trip t ON t.trip_id = r.trip_id JOIN o_pattern p ON p.pattern_id = r.pattern_id
JOIN (SELECT pattern_id, arg_max(stop_id, idx) AS stop_id FROM n_call GROUP BY pattern_id) e ON e.pattern_id = r.pattern_id JOIN a_stop s ON s.stop_id = e.stop_id""")
def bj16(t):
    net, _, _, rides = scheduled(t)
    return b.headsigns(rides, t.a_trip, net._layer, net.stops)


@query("bj10_bj12_alternatives", f"SELECT request_id, CAST(attempt AS BIGINT) AS attempt, CAST(round AS BIGINT) AS round, place, {_J} FROM z_place")
def bj10(t):
    net, req, access, egress = planned(t)
    return b.alternatives(req, access, egress, net, net._positions, b.ALTERNATIVES, b.ROUNDS, b.ALTERNATIVES)[0]


@query("bj13_reasons", """
SELECT r.request_id, CASE WHEN r.request_id NOT IN (SELECT request_id FROM n_from) THEN 'NO_STOP_NEAR_START' WHEN r.request_id NOT IN (SELECT request_id FROM n_to) THEN 'NO_STOP_NEAR_DESTINATION'
 WHEN r.request_id IN (SELECT request_id FROM z_place) THEN 'NONE' WHEN r.request_id IN (SELECT request_id FROM z0_plan) THEN 'NO_SERVICE' ELSE 'NO_JOURNEY' END AS reason FROM a_request r""")
def bj13(t):
    net, req, access, egress = planned(t)
    built, any_plan = b.alternatives(req, access, egress, net, net._positions, b.ALTERNATIVES, b.ROUNDS, b.ALTERNATIVES)
    return b.reasons_for(req, access, egress, any_plan, built)
