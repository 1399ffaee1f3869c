"""Shapes the warehouse tables (orders, lineitem, supplier, ...) into the transit domain's tables.

Each view is one SQL text over base tables and earlier views, restricted to arithmetic, CASE, joins and
window functions, so the same text defines the input of a Spark query and of its cross-check.
Every view reads its tables whole. All doubles are written with an exponent so both engines agree on types.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from wayline.operators.stage import spread, stage

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()

# Views with a row or more per part, made from the part's key alone: Spark would judge them by that one column and broadcast them.
WIDE = {"n_station", "n_step", "n_service", "n_said", "n_shape"}

LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity"

VIEWS: dict[str, str] = {}

# --- bus domain ---------------------------------------------------------------------------------------------
# Every fourth stop stands a short walk from the stop before it.
VIEWS["a_stop"] = """
SELECT stop_id, stop_name,
       8e0 + (CAST(floor(k / 100) AS BIGINT) % 500) * 5e-2 + ((k * 7919) % 1000) / 2e4 + (stop_id - k) * 12e-4 AS lat,
       70e0 + (CAST(floor(k / 50000) AS BIGINT) % 500) * 5e-2 + ((k * 104729) % 1009) / 2e4 AS lon,
       NULLIF(stop_id % 3, 0) AS wheelchair, stop_id % 23 <> 5 AS active
FROM (SELECT s_suppkey AS stop_id, s_name AS stop_name, s_suppkey - CASE WHEN s_suppkey % 4 = 3 THEN 1 ELSE 0 END AS k
      FROM supplier) x"""
VIEWS["a_agency"] = "SELECT n_nationkey AS agency_id, n_name AS agency_name FROM nation"
VIEWS["a_route"] = """
SELECT CAST(floor(c_custkey / 20) AS BIGINT) AS route_id,
       CASE WHEN CAST(floor(c_custkey / 20) AS BIGINT) % 10 = 3 THEN 1000 ELSE min(c_nationkey) END AS agency_id,
       concat('Line ', CAST(CAST(floor(c_custkey / 20) AS BIGINT) % 40 AS VARCHAR(20))) AS long_name,
       CAST(floor(c_custkey / 20) AS BIGINT) % 17 <> 4 AS active
FROM customer GROUP BY CAST(floor(c_custkey / 20) AS BIGINT)"""
VIEWS["a_service"] = """
SELECT service_id, d, CAST(CASE WHEN d = 5 THEN DATE '2024-01-04' ELSE DATE '2024-01-01' END AS DATE) AS start_date,
       CAST(CASE WHEN d = 4 THEN DATE '2024-01-12' ELSE DATE '2024-06-30' END AS DATE) AS end_date,
       concat(',', CASE WHEN (d * 2) % 3 <> 0 OR d = 3 THEN 'monday,' ELSE '' END, CASE WHEN (d * 3) % 3 <> 0 OR d = 3 THEN 'tuesday,' ELSE '' END, CASE WHEN (d * 4) % 3 <> 0 OR d = 3 THEN 'wednesday,' ELSE '' END, CASE WHEN (d * 5) % 3 <> 0 OR d = 3 THEN 'thursday,' ELSE '' END, CASE WHEN (d * 6) % 3 <> 0 OR d = 3 THEN 'friday,' ELSE '' END, CASE WHEN (d * 7) % 3 <> 0 OR d = 3 THEN 'saturday,' ELSE '' END, CASE WHEN (d * 8) % 3 <> 0 OR d = 3 THEN 'sunday,' ELSE '' END) AS days
FROM (SELECT DISTINCT o_orderpriority AS service_id,
             CAST(substring(o_orderpriority, 1, 1) AS INT) AS d FROM orders) x"""
# last write wins per (service, date)
VIEWS["a_service_date_raw"] = """
SELECT event_id AS row_pos, CAST(user_id % 7 AS INT) AS d, CAST(ts AS DATE) AS service_date,
       event_type NOT IN ('error', 'click') AS added
FROM events"""
VIEWS["a_trip"] = """
SELECT o_orderkey AS trip_id, tpl, CAST(floor(tpl / 2) AS BIGINT) AS route_id, o_orderpriority AS service_id,
       18000 + (o_orderkey * 97) % 72000 AS start_s,
       CASE WHEN tpl % 5 <> 0 THEN (tpl + CASE WHEN tpl % 7 = 0 THEN o_orderkey % 2 ELSE 0 END) % 2 END AS direction_id,
       CASE WHEN tpl % 3 = 0 THEN concat('To ', CAST(tpl AS VARCHAR(20)))
            WHEN tpl % 3 = 1 AND o_orderkey % 50 <> 0 THEN concat('Via ', CAST(tpl AS VARCHAR(20))) END AS headsign
FROM (SELECT o_orderkey, o_orderpriority, CAST(floor(o_custkey / 10) AS BIGINT) AS tpl FROM orders) x"""
VIEWS["a_line"] = f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS pos,
       coalesce(sum(CAST(60 + l_quantity * 10 AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
FROM lineitem"""
VIEWS["a_stop_time"] = """
SELECT t.trip_id, CAST(l.pos * 2 + 1 AS BIGINT) AS stop_sequence,
       CAST((t.tpl * 37 + l.pos * (7 + t.tpl % 9)) % (SELECT count(*) FROM supplier) AS BIGINT) AS stop_id,
       CAST(CASE WHEN l.l_partkey % 401 = 7 THEN NULL ELSE t.start_s + l.off END AS BIGINT) AS arrival_s,
       CAST(CASE WHEN l.l_partkey % 401 = 7 OR l.l_partkey % 11 = 3 THEN NULL ELSE t.start_s + l.off + 20 + CASE WHEN l.l_partkey % 97 = 11 THEN 900 ELSE 0 END END AS BIGINT)
            AS departure_s
FROM a_trip t JOIN a_line l ON l.l_orderkey = t.trip_id"""

# --- raw feed rows: every column is text; row_pos is the position in the file ----------------------------------
VIEWS["raw_agency"] = """
SELECT c_custkey AS row_pos, CASE WHEN c_custkey % 37 = 3 THEN '' ELSE concat('A', CAST(c_nationkey AS VARCHAR(20))) END
            AS agency_id,
       CASE WHEN c_custkey % 29 = 5 THEN '  ' ELSE concat(c_mktsegment, '  bus ', CAST(c_nationkey AS VARCHAR(20))) END
            AS agency_name
FROM customer"""
VIEWS["raw_stop"] = """
SELECT l_orderkey * 100 + pos AS row_pos,
       CASE WHEN l_partkey % 211 = 1 THEN '' ELSE concat('S', CAST(l_suppkey * 20 + l_partkey % 20 AS VARCHAR(20))) END AS stop_id,
       CASE WHEN l_partkey % 31 = 2 THEN '' ELSE concat(' Stop  ', CAST(l_suppkey AS VARCHAR(20))) END AS stop_name,
       CASE WHEN l_orderkey % 41 = 3 THEN 'abc' WHEN l_orderkey % 41 = 4 THEN '95.5' WHEN l_orderkey % 41 = 5 THEN '0'
            WHEN l_orderkey % 41 = 6 THEN '50.25' WHEN l_orderkey % 41 = 7 THEN 'NaN'
            ELSE concat('28.', CAST(1000000 + (l_suppkey * 7919) % 1000000 AS VARCHAR(20))) END AS stop_lat,
       CASE WHEN l_orderkey % 41 = 5 THEN '0' ELSE concat('77.', CAST(1000000 + (l_partkey * 104729) % 1000000 AS VARCHAR(20))) END
            AS stop_lon,
       CASE WHEN l_linenumber = 6 THEN '1' WHEN l_linenumber = 7 THEN '2' WHEN l_linenumber = 5 THEN '0' ELSE '' END
            AS location_type,
       CASE WHEN l_orderkey % 53 = 9 THEN 'x' ELSE CAST(l_partkey % 4 AS VARCHAR(20)) END AS wheelchair_boarding
FROM a_line"""
VIEWS["raw_route"] = """
SELECT p_partkey AS row_pos,
       CASE WHEN p_partkey % 97 = 1 THEN ' ' ELSE concat('R', CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS VARCHAR(20))) END AS route_id,
       CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name END AS route_long_name,
       CASE WHEN p_size % 6 = 0 THEN '' ELSE concat('N', CAST(p_size AS VARCHAR(20))) END AS route_short_name,
       CASE WHEN p_partkey % 13 = 2 THEN '' WHEN p_partkey % 17 = 3 THEN 'A999'
            ELSE concat('A', CAST(p_partkey % 25 AS VARCHAR(20))) END AS agency_id,
       CASE WHEN p_partkey % 19 = 4 THEN 'tram' WHEN p_partkey % 23 = 5 THEN '-1' ELSE '3' END AS route_type,
       CASE WHEN p_partkey % 5 = 0 THEN 'ff00aa' WHEN p_partkey % 5 = 1 THEN '12345' ELSE '' END AS route_color
FROM part"""
VIEWS["raw_calendar"] = """
SELECT c_custkey AS row_pos,
       CASE WHEN c_custkey % 43 = 2 THEN '' ELSE concat('C', CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS VARCHAR(20))) END AS service_id,
       CASE WHEN c_custkey % 15 = 7 THEN '2024-01-01' ELSE '20240101' END AS start_date,
       CASE WHEN c_custkey % 14 = 3 THEN '20231231' WHEN c_custkey % 16 = 5 THEN '20241399'
            ELSE concat('2024', CAST(1000 + (c_custkey % 3) * 100 + 10 + c_custkey % 19 AS VARCHAR(20))) END AS end_date,
       CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0' END AS monday,
       CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '0' END AS tuesday,
       CASE WHEN c_custkey % 4 = 0 THEN '1' ELSE '0' END AS wednesday,
       CASE WHEN c_custkey % 5 = 0 THEN '1' ELSE '0' END AS thursday,
       CASE WHEN c_custkey % 6 <> 0 THEN '1' ELSE '0' END AS friday,
       CASE WHEN c_custkey % 21 = 8 THEN 'yes' WHEN c_custkey % 7 = 0 THEN '1' ELSE '0' END AS saturday,
       CASE WHEN c_custkey % 8 = 0 THEN '1' ELSE '0' END AS sunday
FROM customer"""
VIEWS["raw_calendar_date"] = """
SELECT event_id AS row_pos,
       CASE WHEN event_id % 83 = 1 THEN '' ELSE concat('C', CAST(user_id % 400 AS VARCHAR(20))) END AS service_id,
       CASE WHEN event_id % 31 = 4 THEN '20241340' WHEN event_id % 37 = 4 THEN 'soon'
            ELSE concat('202401', CAST(10 + CAST(floor(value) AS BIGINT) % 20 AS VARCHAR(20))) END AS date,
       CASE event_type WHEN 'signup' THEN '1' WHEN 'error' THEN '2' WHEN 'view' THEN '1' WHEN 'click' THEN '2' ELSE '9' END
            AS exception_type
FROM events"""
VIEWS["raw_shape"] = """
SELECT l_orderkey * 100 + pos AS row_pos,
       CASE WHEN l_partkey % 307 = 1 THEN '' ELSE concat('H', CAST(CAST(floor(l_orderkey / 2) AS BIGINT) AS VARCHAR(20))) END AS shape_id,
       CASE WHEN l_partkey % 41 = 3 THEN '95' WHEN l_partkey % 43 = 3 THEN 'x' WHEN l_partkey % 10 = 3 THEN '28.5'
            ELSE concat('28.', CAST(1000000 + (l_suppkey * 7919) % 1000000 AS VARCHAR(20))) END AS shape_pt_lat,
       CASE WHEN l_partkey % 10 = 3 THEN '77.1' ELSE concat('77.', CAST(1000000 + (l_partkey * 104729) % 1000000 AS VARCHAR(20))) END
            AS shape_pt_lon,
       CASE WHEN l_partkey % 47 = 3 THEN '-2' ELSE CAST((l_orderkey % 2) * 5 + l_linenumber AS VARCHAR(20)) END AS shape_pt_sequence
FROM a_line"""
VIEWS["raw_trip"] = """
SELECT o_orderkey AS row_pos,
       CASE WHEN o_orderkey % 101 = 7 THEN '' WHEN o_orderkey % 59 = 8 THEN concat('T', CAST(o_orderkey - 1 AS VARCHAR(20)))
            ELSE concat('T', CAST(o_orderkey AS VARCHAR(20))) END AS trip_id,
       concat('R', CAST(o_custkey % (SELECT CAST(ceil(count(*) / 3e0) AS BIGINT) FROM part) AS VARCHAR(20))) AS route_id,
       CASE WHEN o_orderkey % 71 = 9 THEN '' ELSE concat('C', CAST(o_orderkey % 390 AS VARCHAR(20))) END AS service_id,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('H', CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS VARCHAR(20))) END AS shape_id,
       CASE WHEN o_orderkey % 4 = 0 THEN concat('To  ', o_orderpriority) ELSE '' END AS trip_headsign,
       CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN '7' ELSE CAST(o_orderkey % 2 AS VARCHAR(20)) END AS direction_id
FROM orders"""
# Some rows of a trip are moved to the end of the file, so the trip reappears there.
VIEWS["raw_stop_time"] = """
SELECT l_orderkey * 100 + pos + CASE WHEN l_partkey % 97 = 5 THEN 1000000000000 ELSE 0 END AS row_pos,
       concat('T', CAST(l_orderkey AS VARCHAR(20))) AS trip_id,
       CASE WHEN l_partkey % 50 = 0 THEN 'S?' ELSE concat('S', CAST(l_suppkey * 20 + l_partkey % 20 AS VARCHAR(20))) END AS stop_id,
       CASE WHEN l_partkey % 61 = 3 THEN 'x' WHEN l_partkey % 61 = 4 THEN '-1' ELSE CAST(l_linenumber AS VARCHAR(20)) END AS stop_sequence,
       CASE WHEN l_partkey % 89 = 3 THEN 'xx:yy' WHEN l_partkey % 23 = 3 THEN ''
            ELSE concat(CAST(CAST(floor(sec / 3600) AS BIGINT) AS VARCHAR(20)), ':',
                        substring(CAST(100 + CAST(floor(sec / 60) AS BIGINT) % 60 AS VARCHAR(20)), 2, 2), ':',
                        substring(CAST(100 + sec % 60 AS VARCHAR(20)), 2, 2)) END AS arrival_time,
       CASE WHEN l_partkey % 83 = 3 THEN '0:00:05'
            ELSE concat(CAST(CAST(floor((sec + 30) / 3600) AS BIGINT) AS VARCHAR(20)), ':',
                        substring(CAST(100 + CAST(floor((sec + 30) / 60) AS BIGINT) % 60 AS VARCHAR(20)), 2, 2), ':',
                        substring(CAST(100 + (sec + 30) % 60 AS VARCHAR(20)), 2, 2)) END AS departure_time
FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, pos,
             21600 + (l_orderkey * 97) % 60000 + CASE WHEN l_orderkey % 19 = 2 THEN 3000 - l_linenumber * 200 ELSE l_linenumber * 200 END AS sec
      FROM a_line) x"""

# --- route alternatives of a search session ------------------------------------------------------------------
VIEWS["a_option"] = """
SELECT l_orderkey AS session_id, l_orderkey * 100 + pos AS route_id, pos AS idx,
       CAST(l_quantity * 60 AS BIGINT) AS duration_s, CAST(l_partkey * 13 % 20000 AS BIGINT) AS distance_m,
       CAST(l_linenumber - 1 AS BIGINT) AS transfers, l_partkey % 1500 AS walking_m,
       CASE WHEN l_partkey % 10 <> 0 THEN l_suppkey % 9 * 10 END AS fare,
       CASE WHEN l_partkey % 10 <> 0 THEN CASE WHEN l_orderkey % 11 = 0 AND l_linenumber = 1 THEN 'USD' ELSE 'INR' END END AS currency,
       CASE l_orderkey % 4 WHEN 0 THEN 'FOUR_WHEELER' WHEN 1 THEN 'METRO' WHEN 2 THEN 'BUS' ELSE 'TRAIN' END AS mode,
       l_suppkey, l_partkey
FROM a_line"""
VIEWS["a_option_area"] = """
SELECT o.session_id, o.route_id, o.idx, n.n_nationkey AS area_id,
       CASE WHEN n.n_nationkey % 7 = 0 THEN concat('  Lake  View ', CAST(n.n_nationkey % 2 AS VARCHAR(20)))
            ELSE concat('Nation ', n.n_name) END AS name,
       CASE n.n_nationkey % 4 WHEN 0 THEN 'CITY' WHEN 1 THEN 'TOWN' WHEN 2 THEN 'VILLAGE' ELSE 'SUBURB' END AS area_type,
       row_number() OVER (PARTITION BY o.route_id ORDER BY n.n_nationkey) AS sequence,
       ((n.n_nationkey * 17 + o.idx) % 130) / 100e0 - 0.1e0 AS position
FROM a_option o JOIN nation n ON (o.l_partkey + o.l_suppkey * (n.n_nationkey + 1)) % 7 = n.n_nationkey % 7"""
VIEWS["a_search"] = """
SELECT o_orderkey AS session_id,
       CASE o_orderkey % 6 WHEN 0 THEN '  Lake view' WHEN 1 THEN 'NATION' WHEN 2 THEN 'view 1' WHEN 3 THEN '   '
            WHEN 4 THEN 'nation nation_3' ELSE 'zzz' END AS query
FROM orders"""
VIEWS["a_selected"] = """
SELECT DISTINCT l_orderkey AS session_id,
       CASE WHEN l_partkey % 7 = 0 THEN concat('lake view ', CAST(l_partkey % 2 AS VARCHAR(20)))
            ELSE concat('nation nation_', CAST(l_partkey % 25 AS VARCHAR(20))) END AS name_key,
       CASE l_partkey % 4 WHEN 0 THEN 'CITY' WHEN 1 THEN 'TOWN' WHEN 2 THEN 'VILLAGE' ELSE 'SUBURB' END AS area_type,
       CAST(l_partkey % 25 + CASE WHEN l_partkey % 3 = 0 THEN 100 ELSE 0 END AS BIGINT) AS area_id
FROM lineitem"""

VIEWS["a_leg"] = """
SELECT session_id, route_id, 0 AS leg, CASE l_suppkey % 8 WHEN 0 THEN 'SUBWAY' WHEN 1 THEN ' metro_rail ' WHEN 2 THEN 'BUS' WHEN 3 THEN 'TRAM'
       WHEN 4 THEN 'hovercraft' WHEN 5 THEN NULL WHEN 6 THEN 'HEAVY_RAIL' ELSE 'FERRY' END AS vehicle FROM a_option
UNION ALL
SELECT session_id, route_id, 1 AS leg, CASE l_partkey % 5 WHEN 0 THEN 'INTERCITY_BUS' WHEN 1 THEN 'RAIL' WHEN 2 THEN 'CABLE_CAR' WHEN 3 THEN 'URBAN_RAIL'
       ELSE 'warp' END AS vehicle FROM a_option"""
VIEWS["a_pref"] = """
SELECT o_orderkey AS session_id, o_orderkey % 2 = 0 AS fastest, o_orderkey % 3 = 0 AS lowest_fare, o_orderkey % 5 < 3 AS fewer_transfers,
       o_orderkey % 7 < 3 AS less_walking, o_orderkey % 8 IN (1, 2, 5) AS step_free, o_orderkey % 6 < 2 AS avoid_inaccessible,
       CASE o_orderkey % 9 WHEN 0 THEN 'BUS' WHEN 1 THEN 'METRO,TRAIN' WHEN 2 THEN 'FOUR_WHEELER' WHEN 3 THEN 'TRAIN' ELSE '' END AS avoid
FROM orders"""
VIEWS["a_access_point"] = """
SELECT session_id, route_id, 0 AS ord, l_suppkey % 50 AS stop_key, 'BOARDING' AS kind,
       CASE (l_suppkey + l_partkey) % 5 WHEN 0 THEN 'INACCESSIBLE' WHEN 1 THEN 'UNKNOWN' ELSE 'ACCESSIBLE' END AS status
FROM a_option WHERE mode IN ('METRO', 'BUS')
UNION ALL
SELECT session_id, route_id, 1 AS ord, l_partkey % 50 AS stop_key, 'EXIT' AS kind,
       CASE l_suppkey % 4 WHEN 0 THEN 'UNKNOWN' ELSE 'ACCESSIBLE' END AS status
FROM a_option WHERE mode IN ('METRO', 'BUS')
UNION ALL
SELECT session_id, route_id, 2 AS ord, (l_partkey + l_suppkey % 2) % 50 AS stop_key, 'TRANSFER' AS kind,
       CASE l_partkey % 7 WHEN 0 THEN 'INACCESSIBLE' ELSE 'ACCESSIBLE' END AS status
FROM a_option WHERE mode IN ('METRO', 'BUS') AND transfers > 1"""

# --- saved and recent journeys -----------------------------------------------------------------------------
VIEWS["a_recent"] = """
SELECT event_id, user_id, ts,
       concat(substring(props, 7, 1), '>', CAST(CAST(floor(value) AS BIGINT) % 9 AS VARCHAR(20)), '@', event_type) AS journey_key
FROM events"""

# --- areas ---------------------------------------------------------------------------------------------------
# One rectangle per customer on a grid of 0.0125 degree cells, and one wide strip per twenty customers.
_GX = "70e0 + (CAST(floor(c_custkey / 16000) AS BIGINT) % 500) * 5e-2 + 1.23e-5"
_GY = "8e0 + (CAST(floor(c_custkey / 4) AS BIGINT) % 4000) * 1.25e-2 + 1.71e-5"
VIEWS["a_rect"] = f"""
SELECT area_id, name, area_type, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM (
 SELECT c_custkey AS area_id,
        CASE WHEN c_custkey % 3 = 0 THEN concat('Place ', CAST(CAST(floor(c_custkey / 6) AS BIGINT) AS VARCHAR(20)))
             ELSE concat('Place ', c_name) END AS name,
        CASE c_custkey % 7 WHEN 0 THEN 'CITY' WHEN 1 THEN 'TOWN' WHEN 2 THEN 'VILLAGE' WHEN 3 THEN 'SECTOR'
             WHEN 4 THEN 'SUBURB' WHEN 5 THEN 'LOCALITY' ELSE 'OTHER' END AS area_type,
        {_GX} + (c_custkey % 4) * 1.25e-2 AS x0, {_GY} AS y0, 1.25e-2 + (c_custkey % 3) * 1e-3 AS w, 1.25e-2 + (c_custkey % 2) * 1e-3 AS h
 FROM customer
 UNION ALL
 SELECT 1000000000 + c_custkey AS area_id, concat('District ', CAST(c_custkey AS VARCHAR(20))) AS name,
        CASE WHEN c_custkey % 40 = 0 THEN 'DISTRICT' ELSE 'MUNICIPALITY' END AS area_type,
        {_GX} AS x0, {_GY} AS y0, 5e-2 AS w, 5e-2 AS h
 FROM customer WHERE c_custkey % 20 = 0) x"""
VIEWS["a_request"] = """
SELECT c_custkey AS request_id,
       o.lat + (c_custkey % 21 - 10) * 1e-4 AS from_lat, o.lon + (c_custkey % 19 - 9) * 1e-4 AS from_lon,
       t.lat + (c_custkey % 17 - 8) * 1e-4 AS to_lat, t.lon + (c_custkey % 13 - 6) * 1e-4 AS to_lon,
       21600 + (c_custkey * 131) % 64800 AS depart_s, DATE '2024-01-03' + CAST(c_custkey % 3 AS INT) AS day,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'FEWER_TRANSFERS' WHEN 'BUILDING' THEN 'LESS_WALKING' ELSE 'DEFAULT' END AS preference
FROM (SELECT c_custkey, c_mktsegment, c_custkey % n AS from_stop, (c_custkey * 37 + 11) % n AS to_stop
      FROM (SELECT c_custkey, c_mktsegment, (SELECT count(*) FROM supplier) AS n FROM customer) x) c
JOIN a_stop o ON o.stop_id = c.from_stop JOIN a_stop t ON t.stop_id = c.to_stop"""
VIEWS["a_window"] = """
SELECT request_id AS window_id, from_lat - 1e-2 AS south, from_lon - 1e-2 - (request_id % 3) * 4e-3 AS west,
       CASE WHEN request_id % 50 = 7 THEN from_lat - 2e-2 WHEN request_id % 50 = 8 THEN from_lat + 5e-2 WHEN request_id % 50 = 9 THEN 95e0
            ELSE from_lat + 1e-2 + (request_id % 2) * 8e-3 END AS north, from_lon + 1e-2 AS east
FROM a_request"""
# A route line: the stops an order's lines call at, shifted so that most vertices differ.
VIEWS["a_vertex"] = """
SELECT t.trip_id AS route_id, CAST(st.stop_sequence AS BIGINT) AS seq, s.lat, s.lon
FROM a_stop_time st JOIN a_trip t ON t.trip_id = st.trip_id JOIN a_stop s ON s.stop_id = st.stop_id"""
# --- metro feed: lines of forty stations that share ten with the next line; trips cover a stretch, half of them backwards
VIEWS["raw_m_stop"] = """
SELECT p_partkey AS row_pos, CASE WHEN p_partkey % 97 = 5 THEN concat('M', CAST(p_partkey - 1 AS VARCHAR(20))) WHEN p_partkey % 211 = 9 THEN ''
            ELSE concat('M', CAST(p_partkey AS VARCHAR(20))) END AS stop_id,
       CASE WHEN p_partkey % 83 = 7 THEN '' WHEN p_partkey % 10 = 9 THEN concat('Halt ', CAST(p_partkey - 1 AS VARCHAR(20)), ' (Rapid)')
            WHEN p_partkey % 20 = 3 THEN concat('Halt ', CAST(p_partkey - 1 AS VARCHAR(20))) ELSE concat('Halt ', CAST(p_partkey AS VARCHAR(20))) END AS stop_name,
       CASE WHEN p_partkey % 89 = 7 THEN 'north' ELSE CAST(28 + (k % 1000) * 9e-3 + (p_partkey - k) * 1e-3 AS VARCHAR(20)) END AS stop_lat,
       CAST(70 + (CAST(floor(k / 1000) AS BIGINT) % 50) * 5e-1 AS VARCHAR(20)) AS stop_lon,
       CASE WHEN p_partkey % 61 = 11 THEN '2' WHEN p_partkey % 67 = 11 THEN 'x' WHEN p_partkey % 15 = 4 THEN '1' ELSE '' END AS location_type,
       CASE WHEN p_partkey % 15 = 5 THEN concat('M', CAST(p_partkey - 1 AS VARCHAR(20))) ELSE '' END AS parent_station,
       CAST(p_partkey % 3 AS VARCHAR(20)) AS wheelchair_boarding
FROM (SELECT p_partkey, p_partkey - CASE WHEN p_partkey % 10 = 9 OR p_partkey % 20 = 3 THEN 1 ELSE 0 END AS k FROM part) x"""
VIEWS["raw_m_route"] = """
SELECT c_custkey AS row_pos, concat('L', CAST(CAST(floor(c_custkey / 25) AS BIGINT) AS VARCHAR(20))) AS route_id,
       CASE WHEN c_custkey % 31 = 1 THEN '' WHEN c_custkey % 2 = 0 THEN concat('Line ', CAST(CAST(floor(c_custkey / 100) AS BIGINT) AS VARCHAR(20)), ' (East)')
            ELSE concat('Line ', CAST(CAST(floor(c_custkey / 100) AS BIGINT) AS VARCHAR(20))) END AS route_long_name,
       CASE WHEN c_custkey % 31 = 1 AND c_custkey % 2 = 0 THEN '' ELSE concat('N', CAST(c_custkey % 7 AS VARCHAR(20))) END AS route_short_name,
       CASE WHEN c_custkey % 100 >= 75 THEN '' ELSE concat('00', CAST(1000 + CAST(floor(c_custkey / 100) AS BIGINT) % 9000 AS VARCHAR(20))) END AS route_color
FROM customer"""
VIEWS["raw_m_trip"] = """
SELECT o_orderkey AS row_pos, CASE WHEN o_orderkey % 101 = 7 THEN '' WHEN o_orderkey % 59 = 8 THEN concat('T', CAST(o_orderkey - 1 AS VARCHAR(20)))
            ELSE concat('T', CAST(o_orderkey AS VARCHAR(20))) END AS trip_id,
       CASE WHEN o_orderkey % 71 = 9 THEN 'L?' ELSE concat('L', CAST(CAST(floor(o_custkey / 25) AS BIGINT) AS VARCHAR(20))) END AS route_id FROM orders"""
VIEWS["raw_m_stop_time"] = """
SELECT l.l_orderkey * 100 + l.pos AS row_pos, concat('T', CAST(l.l_orderkey AS VARCHAR(20))) AS trip_id,
       CASE WHEN l.l_partkey % 53 = 1 THEN 'M?' ELSE concat('M', CAST((CAST(floor(o.o_custkey / 25) AS BIGINT) * 30 + CASE WHEN o.o_orderkey % 2 = 0
            THEN (o.o_orderkey % 5) * 2 + l.pos ELSE 30 - (o.o_orderkey % 5) * 2 - l.pos END) % (SELECT count(*) FROM part) AS VARCHAR(20))) END AS stop_id,
       CASE WHEN l.l_partkey % 61 = 3 THEN '-1' WHEN l.l_partkey % 47 = 3 THEN '1' ELSE CAST(l.pos + 1 AS VARCHAR(20)) END AS stop_sequence
FROM a_line l JOIN orders o ON o.o_orderkey = l.l_orderkey"""

VIEWS["a_osm"] = """
SELECT p_partkey AS osm_id, CASE p_partkey % 10 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS kind,
       CASE p_size % 12 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' WHEN 3 THEN 'hamlet' WHEN 4 THEN 'suburb'
            WHEN 5 THEN 'quarter' WHEN 6 THEN 'neighbourhood' WHEN 7 THEN 'island' END AS place,
       CASE WHEN p_size % 3 <> 0 THEN 'administrative' WHEN p_size % 2 = 0 THEN 'maritime' END AS boundary,
       CASE WHEN p_size % 5 = 4 THEN 'x' ELSE CAST(p_size % 11 + 2 AS VARCHAR(20)) END AS admin_level,
       CASE WHEN p_partkey % 13 = 0 THEN 'school' END AS amenity,
       CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN '  '
            WHEN p_partkey % 11 = 0 THEN concat('Sector ', CAST(p_size AS VARCHAR(20))) ELSE concat(' ', p_name, '  x') END AS name
FROM part"""
# Stated parents: every seventh child has two claims, and some chains close into a loop.
VIEWS["a_claim"] = """
SELECT p_partkey AS child, CASE WHEN p_partkey % 50 IN (3, 4, 5) THEN p_partkey + CASE WHEN p_partkey % 50 = 5 THEN -2 ELSE 1 END
            WHEN p_partkey % 31 = 7 THEN p_partkey + 1000000000 ELSE CAST(floor(p_partkey / 2) AS BIGINT) END AS parent
FROM part WHERE p_partkey > 0
UNION ALL
SELECT p_partkey AS child, CAST(floor(p_partkey / 3) AS BIGINT) AS parent FROM part WHERE p_partkey % 7 = 2 AND p_partkey > 0"""
VIEWS["a_text"] = """
SELECT doc_id, text FROM documents"""
VIEWS["a_snapshot_old"] = """
SELECT s_suppkey AS external_id, s_name AS name, s_nationkey AS kind, s_suppkey % 6 <> 4 AS active
FROM supplier WHERE s_suppkey % 10 <> 0"""
VIEWS["a_snapshot_new"] = """
SELECT s_suppkey AS external_id, CASE WHEN s_suppkey % 7 = 0 THEN concat(s_name, ' renamed') ELSE s_name END AS name,
       CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_nationkey END AS kind
FROM supplier WHERE s_suppkey % 10 <> 1"""

# --- borders as loose lines -----------------------------------------------------------------------------------
VIEWS["a_number"] = """
SELECT n.n_nationkey * 5 + r.r_regionkey AS j FROM nation n JOIN region r ON r.r_regionkey < 5"""
# Rectangles of an area: kind of border by the part's number, cut into m lines a side, of which the first ``pieces`` are there.
VIEWS["a_border"] = """
SELECT p_partkey AS area_id, p_partkey % 12 AS kind, 70e0 + (p_partkey % 1000) * 5e-2 AS x, 5e0 + (CAST(floor(p_partkey / 1000) AS BIGINT) % 500) * 5e-2 AS y,
       0.01e0 + p_size * 2e-4 AS w, 0.02e0 + p_size * 1e-4 AS h, CAST(1 + p_size % 25 AS BIGINT) AS m, p_partkey % 12 = 9 AS incomplete
FROM part"""
VIEWS["a_border_ring"] = """
SELECT area_id, 'outer' AS role, 0 AS r, x, y, w, h, m, CASE WHEN kind = 2 THEN 4 * m - 1 ELSE 4 * m END AS pieces FROM a_border WHERE kind NOT IN (8, 11)
UNION ALL SELECT area_id, 'outer', 1, x + w, y + h, w, h, m, 4 * m FROM a_border WHERE kind = 3
UNION ALL SELECT area_id, 'inner', 0, x + w * 0.125e0, y + h * 0.125e0, w * 0.75e0, h * 0.75e0, m, 4 * m FROM a_border WHERE kind = 5
UNION ALL SELECT area_id, 'outer', 1, x + w * 0.25e0, y + h * 0.25e0, w * 0.5e0, h * 0.5e0, m, 4 * m FROM a_border WHERE kind = 5
UNION ALL SELECT area_id, 'inner', 1, x + w * 0.375e0, y + h * 0.375e0, w * 0.25e0, h * 0.25e0, m, 4 * m FROM a_border WHERE kind = 5
UNION ALL SELECT area_id, 'inner', 0, x + w * CASE WHEN kind = 6 THEN 2e0 ELSE 0.25e0 END, y + h * 0.25e0, w * 0.5e0, h * 0.5e0, m,
  CASE WHEN kind = 7 THEN 4 * m - 1 ELSE 4 * m END FROM a_border WHERE kind IN (4, 6, 7, 8)"""
# One place on a rectangle per step; a line runs from one to the next, every third one backward; whole rings are one line.
VIEWS["a_border_place"] = """
SELECT b.area_id, b.role, b.r, b.m, b.pieces, n.j, b.x + b.w * CASE floor(n.j / b.m) WHEN 0 THEN (n.j % b.m) / CAST(b.m AS DOUBLE) WHEN 1 THEN 1e0 WHEN 2 THEN 1e0 - (n.j % b.m) / CAST(b.m AS DOUBLE) ELSE 0e0 END AS x,
       b.y + b.h * CASE floor(n.j / b.m) WHEN 0 THEN 0e0 WHEN 1 THEN (n.j % b.m) / CAST(b.m AS DOUBLE) WHEN 2 THEN 1e0 ELSE 1e0 - (n.j % b.m) / CAST(b.m AS DOUBLE) END AS y
FROM a_border_ring b JOIN a_number n ON n.j < 4 * b.m"""
VIEWS["a_border_point"] = """
SELECT area_id, role, CAST(r * 1000 + (j + area_id) % (4 * m) AS BIGINT) AS line, CAST((j * 7 + area_id) % 3 % 2 AS BIGINT) AS seq, x, y FROM a_border_place WHERE area_id % 12 > 0 AND j < pieces
UNION ALL SELECT p.area_id, p.role, CAST(p.r * 1000 + (q.j + p.area_id) % (4 * p.m) AS BIGINT), CAST(1 - (q.j * 7 + p.area_id) % 3 % 2 AS BIGINT), p.x, p.y
FROM a_border_place p JOIN (SELECT area_id, role, r, j, m, pieces, (j + 1) % (4 * m) AS k FROM a_border_place) q ON q.area_id = p.area_id AND q.role = p.role AND q.r = p.r AND q.k = p.j
WHERE p.area_id % 12 > 0 AND q.j < p.pieces
UNION ALL SELECT area_id, role, CAST(0 AS BIGINT), CAST(j AS BIGINT), x, y FROM a_border_place WHERE area_id % 12 = 0
UNION ALL SELECT area_id, role, CAST(0 AS BIGINT), CAST(4 * m AS BIGINT), x, y FROM a_border_place WHERE area_id % 12 = 0 AND j = 0
UNION ALL SELECT area_id, 'outer', CAST(9000 AS BIGINT), CAST(0 AS BIGINT), x, y FROM a_border WHERE kind = 10"""
# Shapes in a unit square: (shape, role, ring, polygon, place, x, y).
VIEWS["a_shape"] = """
SELECT s AS shape, role, CAST(ring AS BIGINT) AS ring, CAST(polygon AS BIGINT) AS polygon, CAST(i AS BIGINT) AS seq, x / 8e0 AS x, y / 8e0 AS y FROM (
""" + " UNION ALL ".join(
    f"SELECT '{shape}' AS s, '{role}' AS role, {ring} AS ring, {polygon} AS polygon, {i} AS i, {x} AS x, {y} AS y"
    for shape, rings in {
        "square": [("outer", 0, 0, "00 80 88 08 00")], "bent": [("outer", 0, 0, "00 80 84 44 48 08 00")], "bow": [("outer", 0, 0, "00 88 80 08 00")],
        "spike": [("outer", 0, 0, "00 40 80 60 68 08 00")], "eight": [("outer", 0, 0, "00 40 44 84 88 48 44 04 00")],
        "ring": [("outer", 0, 0, "00 80 88 08 00"), ("inner", 1, 0, "22 62 66 26 22")], "hole beside": [("outer", 0, 0, "00 40 48 08 00"), ("inner", 1, 0, "52 72 76 56 52")],
        "hole across": [("outer", 0, 0, "00 50 58 08 00"), ("inner", 1, 0, "32 72 76 36 32")], "shell in shell": [("outer", 0, 0, "00 80 88 08 00"), ("outer", 1, 1, "22 62 66 26 22")],
        "torn": [("outer", 0, 0, "00 40 80 88 48 08 00"), ("inner", 1, 0, "40 64 48 24 40")], "open": [("outer", 0, 0, "00 80 88 08")],
        "shells across": [("outer", 0, 0, "00 60 66 06 00"), ("outer", 1, 1, "33 83 88 38 33")], "hole in hole": [("outer", 0, 0, "00 80 88 08 00"), ("inner", 1, 0, "11 71 77 17 11"), ("inner", 2, 0, "33 53 55 35 33")],
        "island": [("outer", 0, 0, "00 80 88 08 00"), ("inner", 1, 0, "11 71 77 17 11"), ("outer", 2, 2, "33 53 55 35 33")],
        "corner to corner": [("outer", 0, 0, "00 40 44 04 00"), ("outer", 1, 1, "44 84 88 48 44")], "leaning hole": [("outer", 0, 0, "00 80 88 08 00"), ("inner", 1, 0, "40 64 48 24 40".replace("48", "46"))],
    }.items() for role, ring, polygon, path in rings for i, (x, y) in enumerate(path.split())) + """) v"""
VIEWS["a_shape_name"] = """
SELECT shape, row_number() OVER (ORDER BY shape) - 1 AS k FROM (SELECT DISTINCT shape FROM a_shape) x"""
VIEWS["a_shaped"] = """
SELECT p.p_partkey AS area_id, n.shape, CASE p.p_partkey % 29 WHEN 1 THEN NULL WHEN 2 THEN 'LineString' WHEN 3 THEN 'Polygon' ELSE 'MultiPolygon' END AS geometry, p.p_partkey % 29 = 4 AS no_points,
       70e0 + (p.p_partkey % 1000) * 5e-2 AS x, CASE p.p_partkey % 29 WHEN 5 THEN 89.995e0 ELSE 5e0 + (CAST(floor(p.p_partkey / 1000) AS BIGINT) % 500) * 5e-2 END AS y,
       CASE p.p_partkey % 29 WHEN 6 THEN 1e-5 WHEN 7 THEN 8e0 ELSE 0.01e0 + p.p_size * 2e-4 END AS w
FROM part p JOIN a_shape_name n ON n.k = p.p_partkey % 16"""
VIEWS["a_shaped_point"] = """
SELECT a.area_id, s.role, s.ring, s.polygon, s.seq, a.x + a.w * s.x AS x, a.y + a.w * s.y AS y FROM a_shaped a JOIN a_shape s ON s.shape = a.shape WHERE NOT a.no_points"""
# Families of diamonds around one place, shifted against each other; names repeat over many places.
VIEWS["a_diamond"] = """
SELECT p_partkey AS area_id, CAST(floor(p_partkey / 3) AS BIGINT) AS family, concat(CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN 'PLACE ' ELSE 'Place ' END, CAST(CAST(floor(p_partkey / 3) AS BIGINT) % 10 AS VARCHAR(20))) AS name,
       CASE WHEN CAST(floor(p_partkey / 3) AS BIGINT) % 4 = 0 THEN 'TOWN' ELSE 'VILLAGE' END AS area_type, 0.01e0 + (CAST(floor(p_partkey / 3) AS BIGINT) % 5) * 1e-3 AS r,
       (p_partkey % 3 % 2) * ((p_partkey * 7) % 13) * 1.013e-3 AS dx, CAST(floor((p_partkey % 3) / 2) AS BIGINT) * ((p_partkey * 5) % 11) * 1.007e-3 AS dy,
       20e0 + (CAST(floor(p_partkey / 3) AS BIGINT) % 900) * 0.06e0 AS cx, 10e0 + (CAST(floor(p_partkey / 2700) AS BIGINT) % 900) * 0.06e0 AS cy
FROM part"""
VIEWS["a_diamond_point"] = """
SELECT d.area_id, 'outer' AS role, CAST(0 AS BIGINT) AS ring, CAST(0 AS BIGINT) AS polygon, CAST(c.i AS BIGINT) AS seq, d.cx + d.dx + d.r * c.x AS x, d.cy + d.dy + d.r * c.y AS y FROM a_diamond d JOIN (
SELECT 0 AS i, 1e0 AS x, 0e0 AS y UNION ALL SELECT 1, 0.5e0, 0.5e0 UNION ALL SELECT 2, 0e0, 1e0 UNION ALL SELECT 3, -1e0, 0e0 UNION ALL SELECT 4, 0e0, -1e0 UNION ALL SELECT 5, 1e0, 0e0) c ON c.i >= 0"""

# --- metro network and provider steps: blocks of twenty stations; two services of one line that overlap, and an express with a line of its own
VIEWS["n_station"] = """
SELECT concat('S', CAST(1000000 + p_partkey AS VARCHAR(20))) AS station, p_partkey AS k, CAST(floor(p_partkey / 20) AS BIGINT) AS b, p_partkey % 20 AS i,
       concat('Halt ', CAST(p_partkey % 300 AS VARCHAR(20)), CASE p_partkey % 4 WHEN 0 THEN ' North' WHEN 1 THEN ' (Gate 2)' WHEN 2 THEN ' & Park' ELSE '' END) AS name,
       20e0 + (p_partkey % 1000) * 9e-3 AS lat, 70e0 + (CAST(floor(p_partkey / 1000) AS BIGINT) % 500) * 5e-2 AS lon
FROM part"""
VIEWS["n_step"] = """
SELECT concat('A', CAST(x.b AS VARCHAR(20))) AS service, concat('G', CAST(x.b AS VARCHAR(20))) AS group_id, x.station AS a, y.station AS b FROM n_station x JOIN n_station y ON y.b = x.b AND y.i = x.i + 1 WHERE x.i < 14
UNION ALL SELECT concat('B', CAST(x.b AS VARCHAR(20))), concat('G', CAST(x.b AS VARCHAR(20))), y.station, x.station FROM n_station x JOIN n_station y ON y.b = x.b AND y.i = x.i + 1 WHERE x.i >= 8
UNION ALL SELECT concat('C', CAST(x.b AS VARCHAR(20))), concat('E', CAST(x.b AS VARCHAR(20))), x.station, y.station FROM n_station x JOIN n_station y ON y.b = x.b AND y.i = x.i + 5 WHERE x.i % 5 = 0 AND x.i < 15"""
VIEWS["n_service"] = """
SELECT service, group_id, CASE substring(service, 1, 1) WHEN 'C' THEN concat('Express ', substring(service, 2, 9)) ELSE concat('Line ', substring(service, 2, 9)) END AS group_name,
       CASE substring(service, 1, 1) WHEN 'A' THEN concat('Line ', substring(service, 2, 9), ' (West)') WHEN 'B' THEN concat('Eastern ', substring(service, 2, 9)) ELSE concat('Express ', substring(service, 2, 9)) END AS name
FROM (SELECT DISTINCT service, group_id FROM n_step) x"""
VIEWS["n_ride"] = """
SELECT l.l_orderkey AS route_id, l.pos, l.l_partkey AS salt, CAST(floor(o.o_custkey % (SELECT count(*) FROM part) / 20) AS BIGINT) AS b, (l.l_orderkey * 3 + l.pos * 7) % 20 AS i, (l.l_orderkey * 3 + (l.pos + 1) * 7) % 20 AS j
FROM a_line l JOIN orders o ON o.o_orderkey = l.l_orderkey"""
# What a stop is called: as the station, with other words, shortened, wrongly, or not at all; some without a place, some a way off.
VIEWS["n_said"] = """
SELECT station, v, CASE v WHEN 0 THEN name WHEN 1 THEN concat(upper(name), ' Metro Station') WHEN 2 THEN concat('Halt ', CAST(k % 300 AS VARCHAR(20))) WHEN 3 THEN 'Somewhere' WHEN 4 THEN concat('Old ', name, ' Side') ELSE '' END AS name,
       CASE WHEN v IN (1, 4) AND k % 3 = 0 THEN NULL ELSE lat + CASE v WHEN 0 THEN 4e-3 WHEN 3 THEN 5e-4 WHEN 2 THEN 0e0 WHEN 4 THEN 9e-3 ELSE 1e-4 END END AS lat,
       CASE WHEN v IN (1, 4) AND k % 3 = 0 THEN NULL ELSE lon END AS lon, b, i
FROM (SELECT s.*, n.j AS v FROM n_station s JOIN a_number n ON n.j < 6) x"""
VIEWS["n_provider_step"] = """
SELECT r.route_id, CAST(r.pos * 2 + 1 AS BIGINT) AS seq, 'RIDE' AS kind, 100 * r.salt % 5000 AS meters, r.salt % 900 AS seconds, abs(r.j - r.i) + CASE WHEN r.salt % 11 = 3 THEN 1 WHEN r.salt % 13 = 4 THEN -abs(r.j - r.i) ELSE 0 END AS stop_count,
       CASE r.salt % 7 WHEN 0 THEN '' WHEN 1 THEN 'Unheard Of' WHEN 2 THEN concat('Express ', CAST(r.b AS VARCHAR(20))) WHEN 3 THEN concat('Metro line ', CAST(r.b AS VARCHAR(20)), ' to the east') ELSE concat('Line ', CAST(r.b AS VARCHAR(20))) END AS line,
       CASE r.salt % 9 WHEN 0 THEN 'BUS' WHEN 1 THEN 'subway' WHEN 2 THEN 'METRO_RAIL' ELSE 'SUBWAY' END AS vehicle,
       f.name AS from_name, f.lat AS from_lat, f.lon AS from_lon, t.name AS to_name, t.lat AS to_lat, t.lon AS to_lon
FROM n_ride r JOIN n_said f ON f.b = r.b AND f.i = r.i AND f.v = CASE WHEN r.salt % 5 < 3 THEN 0 ELSE r.salt % 6 END JOIN n_said t ON t.b = r.b AND t.i = r.j AND t.v = CASE WHEN r.salt % 4 < 3 THEN 0 ELSE r.salt % 6 END
UNION ALL SELECT route_id, CAST(pos * 2 AS BIGINT), 'WALK', CASE WHEN salt % 6 = 0 THEN 0 ELSE salt % 700 END, CASE WHEN salt % 6 = 0 THEN 0 ELSE salt % 500 END, 0, '', '', '', NULL, NULL, '', NULL, NULL FROM n_ride WHERE salt % 3 = 0
UNION ALL SELECT route_id, CAST(99 AS BIGINT), 'WALK', salt % 300, salt % 200, 0, '', '', '', NULL, NULL, '', NULL, NULL FROM n_ride WHERE pos = 0 AND salt % 2 = 0"""

# --- shapes of the blocks: three vertices a station; every third block runs back again, some lie a kilometre off, some have too few points
VIEWS["n_shape"] = """
SELECT concat('H', CAST(b AS VARCHAR(20))) AS shape_id, CAST(i * 3 + v AS BIGINT) AS seq, lat + v * 3e-3 + CASE WHEN b % 7 = 5 THEN 1e-2 ELSE 1e-4 END AS lat, lon + 2e-4 AS lon, k * 10 + v AS row_pos
FROM (SELECT s.*, n.j AS v FROM n_station s JOIN a_number n ON n.j < 3) x WHERE b % 11 <> 4 OR i * 3 + v < 1
UNION ALL SELECT concat('H', CAST(b AS VARCHAR(20))), CAST(62 + (19 - i) * 3 - v AS BIGINT), lat + v * 3e-3 + CASE WHEN b % 7 = 5 THEN 1e-2 ELSE 1e-4 END, lon + 2e-4, 1000000000 + k * 10 + v
FROM (SELECT s.*, n.j AS v FROM n_station s JOIN a_number n ON n.j < 3) x WHERE b % 3 = 0 AND b % 11 <> 4"""
VIEWS["n_shape_trip"] = """
SELECT o_orderkey AS trip_id, concat('A', CAST(CAST(floor(o_custkey % n / 20) + CASE WHEN o_orderkey % 9 = 4 THEN 1 ELSE 0 END AS BIGINT) AS VARCHAR(20))) AS route_id,
       CASE WHEN o_orderkey % 6 = 1 THEN ' ' ELSE concat('H', CAST(CAST(floor(o_custkey % n / 20) AS BIGINT) AS VARCHAR(20))) END AS shape_id, o_orderpriority AS service_id
FROM (SELECT *, (SELECT count(*) FROM part) AS n FROM orders) x"""
VIEWS["n_journey_ride"] = """
SELECT r.route_id * 100 + r.pos AS ride_id, r.route_id AS journey_id, concat('H', CAST(r.b AS VARCHAR(20))) AS shape_id, f.lat AS board_lat, f.lon AS board_lon, t.lat AS exit_lat, t.lon AS exit_lon
FROM n_ride r JOIN n_station f ON f.b = r.b AND f.i = r.i JOIN n_station t ON t.b = r.b AND t.i = r.j"""
# Route lines in parts: some without points, of another kind or reference, out of range, or all at one place.
VIEWS["n_line"] = """
SELECT o_orderkey AS route_id, CASE o_orderkey % 13 WHEN 1 THEN NULL WHEN 2 THEN 'Point' WHEN 3 THEN 'LineString' ELSE 'MultiLineString' END AS geometry, CASE o_orderkey % 17 WHEN 1 THEN 3857 WHEN 2 THEN 0 WHEN 3 THEN NULL ELSE 4326 END AS srid
FROM orders"""
VIEWS["n_line_point"] = """
SELECT l_orderkey AS route_id, CAST(floor(pos / 2) AS BIGINT) AS part, pos % 2 AS seq, CASE WHEN l_orderkey % 19 = 5 AND pos = 1 THEN 95e0 WHEN l_orderkey % 23 = 6 THEN 10e0 ELSE 10e0 + CAST(floor((pos + 1) / 2) AS BIGINT) % 3 * 1e-2 END AS lat,
       CASE WHEN l_orderkey % 29 = 7 AND pos = 0 THEN NULL ELSE 70e0 END AS lon
FROM a_line WHERE l_orderkey % 31 <> 8"""

_WORD = re.compile(r"\b(" + "|".join(sorted([*BASE, *VIEWS], key=len, reverse=True)) + r")\b(?!\.|_)")


def _refs(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"(?:FROM|JOIN)\s+{n}\b", sql)]


class Tables:
    """Base tables and adapter views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            made = self.spark.read.parquet(f"{self.dir}/{name}.parquet") if name in BASE else self.sql(VIEWS[name])
            self._made[name] = spread(made) if name in WIDE else made
        return self._made[name]

    def keep(self, *names: str) -> None:
        """Writes views that several steps of a query read, so that their windows and joins run once."""
        for n in names:
            self._made[n] = stage(getattr(self, n))

    def sql(self, text: str) -> DataFrame:
        used = _refs(text, [*BASE, *VIEWS])
        for n in used:
            text = re.sub(rf"((?:FROM|JOIN)\s+){n}\b", rf"\g<1>{{{n}}}", text)
        text = re.sub(r"VARCHAR\(20\)", "STRING", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in used})


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefixes a query with the adapter views (and extra named parts) it needs, in dependency order."""
    parts = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def need(text: str):
        for n in _refs(text, parts):
            if n not in order:
                need(parts[n])
                order.append(n)

    need(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({parts[n]})" for n in order) + "\n" + sql
