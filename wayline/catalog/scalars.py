"""Scalar functions over whole columns, request rules, snapshot merge, saved and recent journeys."""

import uuid

from pyspark.sql import functions as F

from wayline.functions import display as ds, scalars as s, text as tx
from wayline.functions.geo import box_degrees, cell, haversine
from wayline.operators.accept import reasons
from wayline.operators.stage import folder, stage
from wayline.plans import merge as mg, saved as sv
from wayline.catalog.bus_feed import DAY, SEC
from wayline.catalog.journeys import hav
from wayline.registry import PARTS, query

CTL = "[\\x00-\\x08\\x0E-\\x1F\\x7F-\\x9F\\p{Cf}]"
SPC = "[ \\t\\n\\x0B\\f\\r\\x{85}\\p{Z}]+"


def shown(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(nfc_normalize({c}), '{CTL}', '', 'g'), '{SPC}', ' ', 'g'))"


def key_of(c: str) -> str:
    k = f"replace(regexp_replace(strip_accents(lower({c})), '\\([^)]*\\)', ' ', 'g'), '&', ' and ')"
    for word in ("\\bmetro\\s+station\\b", "\\bstation\\b", "\\bmetro\\b", "[^\\p{L}\\p{N}]+"):
        k = f"regexp_replace({k}, '{word}', ' ', 'g')"
    return f"trim({k})"


@query("fn1_display", f"SELECT doc_id, {shown('text')} AS shown FROM documents")
def fn1(t):
    return t.documents.select("doc_id", tx.display(F.col("text")).alias("shown"))


@query("fn2_area_name", """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\\n\\r\\t]', ' ', 'g'),
 '[\\p{Cc}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]', '', 'g'), '[ \\t\\n\\x0B\\f\\r\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) AS name FROM documents""")
def fn2(t):
    return t.documents.select("doc_id", F.md5(tx.area_name(F.col("text"))).alias("name"))


NAMED = "concat('Métro Station & (note) ', url)"


@query("fn3_match_key", f"SELECT page_id, {key_of(shown(NAMED))} AS key FROM pages")
def fn3(t):
    return t.pages.select("page_id", tx.match_key(F.concat(F.lit("Métro Station & (note) "), "url")).alias("key"))


@query("fn4_search_name", "SELECT conv_id, turn, md5(lower(trim(regexp_replace(trim(nfc_normalize(text)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))) AS name FROM conversations")
def fn4(t):
    return t.conversations.select("conv_id", "turn", F.md5(tx.search_name(F.col("text"))).alias("name"))


@query("fn5_place_key", "SELECT item_id, md5(lower(regexp_replace(trim(nfc_normalize(text)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS name FROM benchmark")
def fn5(t):
    return t.benchmark.select("item_id", F.md5(tx.place_key(F.col("text"))).alias("name"))


@query("fn6_base_name", """SELECT p_partkey, CASE WHEN n LIKE '%)' THEN split_part(n, ' (', 1) ELSE n END AS base, CASE WHEN n LIKE '%)' THEN replace(split_part(n, ' (', 2), ')', '') END AS branch
FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat(p_name, ' (', p_type, ')') ELSE p_name END AS n FROM part) x""")
def fn6(t):
    n = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", tx.base_name(n).alias("base"), tx.branch_of(n).alias("branch"))


@query("fn7_gtfs_time", f"SELECT row_pos, {SEC.format(c='arrival_time')} AS seconds, trim(arrival_time) <> '' AND {SEC.format(c='arrival_time')} IS NULL AS malformed FROM raw_stop_time")
def fn7(t):
    return t.raw_stop_time.select("row_pos", s.gtfs_seconds(F.col("arrival_time")).alias("seconds"), s.gtfs_malformed(F.col("arrival_time")).alias("malformed"))


@query("fn8_dates", f"SELECT row_pos, day, lower(dayname(day)) AS weekday FROM (SELECT row_pos, {DAY.format(c='date')} AS day FROM raw_calendar_date) x")
def fn8(t):
    d = s.basic_date(F.col("date"))
    return t.raw_calendar_date.select("row_pos", d.alias("day"), s.weekday_name(d).alias("weekday"))


@query("fn9_stable_ids", """SELECT stop_id, concat(substring(h,1,8),'-',substring(h,9,4),'-3',substring(h,14,3),'-',substring('89ab', CAST((strpos('0123456789abcdef', substring(h,17,1)) - 1) % 4 AS INT) + 1, 1), substring(h,18,3),'-',substring(h,21,12)) AS id
FROM (SELECT stop_id, md5(concat('BUS:bus-stop:', CAST(stop_id AS VARCHAR))) AS h FROM a_stop) x""")
def fn9(t):
    return t.a_stop.select("stop_id", s.stable_id(F.lit("BUS"), "bus-stop", F.col("stop_id").cast("string")).alias("id"))


@query("fn10_small_parsers", """SELECT row_pos, CASE WHEN regexp_full_match(route_color, '[0-9A-Fa-f]{6}') THEN concat('#', upper(route_color)) END AS color, NULLIF(trim(route_long_name), '') AS name,
 floor((row_pos * 1.2345678e-3) * 1e6 + 0.5e0) / 1e6 AS rounded FROM raw_route""")
def fn10(t):
    return t.raw_route.select("row_pos", s.color(F.col("route_color")).alias("color"), tx.blank_to_null(F.col("route_long_name")).alias("name"),
                              s.round6(F.col("row_pos") * F.lit(1.2345678e-3)).alias("rounded"))


@query("fn11_fn13_distance", f"SELECT request_id, round(m, 3) AS meters, CAST(floor(m * 1.3e0 / 1.25e0 + 0.5e0) AS BIGINT) AS walk_s FROM (SELECT request_id, {hav('from_lat', 'from_lon', 'to_lat', 'to_lon')} AS m FROM a_request) x")
def fn11(t):
    m = haversine(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    return t.a_request.select("request_id", F.round(m, 3).alias("meters"), s.walk_seconds(m).alias("walk_s"))


@query("fn12_local_instants", "SELECT request_id, strftime(CAST(day AS TIMESTAMP) + to_seconds(depart_s) - INTERVAL '5:30' HOUR TO MINUTE, '%Y-%m-%d %H:%M:%S') AS utc FROM a_request".replace("INTERVAL '5:30' HOUR TO MINUTE", "to_minutes(330)"))
def fn12(t):
    return t.a_request.select("request_id", F.date_format(s.at_zone(F.col("day"), F.col("depart_s"), "Asia/Kolkata"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("fn14_access_status", "SELECT row_pos, CASE wheelchair_boarding WHEN '1' THEN 'ACCESSIBLE' WHEN '2' THEN 'INACCESSIBLE' ELSE 'UNKNOWN' END AS status FROM raw_stop")
def fn14(t):
    return t.raw_stop.select("row_pos", s.access_status(F.col("wheelchair_boarding")).alias("status"))


@query("fn16_display_texts", """SELECT route_id, CASE WHEN distance_m < 1000 THEN concat(CAST(distance_m AS VARCHAR), ' m') ELSE concat(printf('%.1f', distance_m / 1e3), ' km') END AS distance,
 CASE WHEN mins < 60 THEN concat(CAST(mins AS VARCHAR), ' min') WHEN mins % 60 = 0 THEN concat(CAST(mins // 60 AS VARCHAR), ' h') ELSE concat(CAST(mins // 60 AS VARCHAR), ' h ', CAST(mins % 60 AS VARCHAR), ' min') END AS duration,
 CASE WHEN fare IS NULL THEN 'Fare unavailable' WHEN currency = 'INR' THEN concat('₹', CAST(fare AS VARCHAR)) ELSE concat(currency, ' ', CAST(fare AS VARCHAR)) END AS fare,
 CASE WHEN transfers <= 0 THEN 'Direct' WHEN transfers = 1 THEN '1 transfer' ELSE concat(CAST(transfers AS VARCHAR), ' transfers') END AS transfers
FROM (SELECT *, greatest(1, CAST(floor(duration_s / 60 + 0.5e0) AS BIGINT)) AS mins FROM (SELECT * REPLACE (distance_m - distance_m % 100 AS distance_m) FROM a_option) y) x""")
def fn16(t):
    d = F.col("distance_m") - F.col("distance_m") % 100
    return t.a_option.select("route_id", ds.distance(d).alias("distance"), ds.duration(F.col("duration_s")).alias("duration"),
                             ds.fare(F.col("currency"), F.col("fare")).alias("fare"), ds.transfers(F.col("transfers")).alias("transfers"))


VIEW_MODE = "CASE WHEN v IN ('SUBWAY','METRO','METRO_RAIL','URBAN_RAIL') THEN 'METRO' WHEN v IN ('BUS','INTERCITY_BUS','TROLLEYBUS') THEN 'BUS' WHEN v IN ('HEAVY_RAIL','RAIL') THEN 'TRAIN' WHEN v IN ('TRAM','FERRY','CABLE_CAR') THEN 'OTHER' END"


@query("fn15_vehicle_modes", f"SELECT route_id, leg, {VIEW_MODE} AS mode FROM (SELECT route_id, CAST(leg AS BIGINT) AS leg, upper(trim(vehicle)) AS v FROM a_leg) x")
def fn15(t):
    return t.a_leg.select("route_id", "leg", s.vehicle_mode(F.col("vehicle")).alias("mode"))


@query("fn20_geo16_boxes", """SELECT request_id, round(500 / (111320e0 * greatest(0.1e0, cos(radians(from_lat)))), 9) AS degrees, CAST(floor(from_lat / 4e-3) AS BIGINT) AS cy, CAST(floor(from_lon / 4e-3) AS BIGINT) AS cx FROM a_request""")
def fn20(t):
    return t.a_request.select("request_id", F.round(box_degrees(F.lit(500.0), F.col("from_lat")), 9).alias("degrees"),
                              cell(F.col("from_lat"), 0.004).alias("cy"), cell(F.col("from_lon"), 0.004).alias("cx"))


# ---- request rules

@query("val5_location_pairs", """SELECT request_id, CASE WHEN request_id % 17 = 0 THEN 'missing-start' WHEN request_id % 19 = 0 THEN 'missing-destination' WHEN NOT (abs(from_lat) <= 90 AND abs(from_lon) <= 180 AND abs(to_lat) <= 90 AND abs(to_lon) <= 180)
 THEN 'invalid-location' WHEN from_lat = to_lat AND from_lon = to_lon THEN 'same-location' END AS reason FROM a_request""")
def val5(t):
    ok = lambda a, b: F.col(a).between(-90, 90) & F.col(b).between(-180, 180)
    lost = lambda n: F.col("request_id") % n == 0
    d = t.a_request.withColumn("a", F.when(~lost(17), F.col("from_lat"))).withColumn("b", F.when(~lost(19), F.col("to_lat")))
    return d.select("request_id", reasons((F.col("a").isNull(), "missing-start"), (F.col("b").isNull(), "missing-destination"),
                                          (~(ok("from_lat", "from_lon") & ok("to_lat", "to_lon")), "invalid-location"),
                                          ((F.col("from_lat") == F.col("to_lat")) & (F.col("from_lon") == F.col("to_lon")), "same-location")).alias("reason"))


@query("val2_request_times", """SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND user_id % 5 = 0 THEN 'options not allowed' WHEN user_id % 7 = 0 AND event_id % 2 = 0 THEN 'both times'
 WHEN ts < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 5 MINUTE OR ts > TIMESTAMP '2024-01-25 00:00:00' THEN 'time out of range' WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'arrival not allowed' END AS reason FROM events""")
def val2(t):
    ts = F.col("ts").cast("timestamp")
    low, high = F.lit("2024-01-10 00:00:00").cast("timestamp") - F.make_dt_interval(mins=F.lit(5)), F.lit("2024-01-25 00:00:00").cast("timestamp")
    kind, user = F.col("event_type"), F.col("user_id")
    return t.events.select("event_id", reasons((kind.isin("view", "click") & (user % 5 == 0), "options not allowed"),
                                               ((user % 7 == 0) & (F.col("event_id") % 2 == 0), "both times"),
                                               ((ts < low) | (ts > high), "time out of range"),
                                               ((kind == "purchase") & (user % 3 == 0), "arrival not allowed")).alias("reason"))


@query("val1_stop_time_checks", """SELECT trip_id, stop_sequence, CASE WHEN stop_sequence < 0 THEN 'stop_sequence' WHEN departure_s < arrival_s THEN 'departure before arrival' WHEN arrival_s < 0 OR departure_s < 0 THEN 'negative time' END AS reason FROM a_stop_time""")
def val1(t):
    return t.a_stop_time.select("trip_id", "stop_sequence", reasons(
        (F.col("stop_sequence") < 0, "stop_sequence"), (F.col("departure_s") < F.col("arrival_s"), "departure before arrival"),
        ((F.col("arrival_s") < 0) | (F.col("departure_s") < 0), "negative time")).alias("reason"))


# ---- snapshot merge

PARTS["m_full"] = """
SELECT coalesce(o.external_id, n.external_id) AS external_id, o.external_id IS NOT NULL AS in_old, n.external_id IS NOT NULL AS in_new, o.name AS old_name, o.kind AS old_kind, o.active AS was_active, n.name, n.kind,
 CASE WHEN n.external_id IS NULL THEN 'RETIRED' WHEN o.external_id IS NULL THEN 'INSERTED' WHEN o.name IS NOT DISTINCT FROM n.name AND o.kind IS NOT DISTINCT FROM n.kind THEN 'UNCHANGED' ELSE 'UPDATED' END AS outcome
FROM a_snapshot_old o FULL JOIN a_snapshot_new n ON n.external_id = o.external_id"""


@query("mg1_outcomes", "SELECT external_id, outcome FROM m_full")
def mg1(t):
    return mg.merged(t.a_snapshot_old, t.a_snapshot_new, ["external_id"], ["name", "kind"]).select("external_id", "outcome")


@query("mg2_mg3_upserted", "SELECT external_id, CASE WHEN in_new THEN name ELSE old_name END AS name, CAST(CASE WHEN in_new THEN kind ELSE old_kind END AS BIGINT) AS kind, in_new AS active, outcome FROM m_full")
def mg2(t):
    return mg.upserted(t.a_snapshot_old, t.a_snapshot_new, ["external_id"], ["name", "kind"])


@query("mg6_store_counts", "SELECT CASE WHEN outcome = 'RETIRED' AND NOT was_active THEN 'ALREADY_INACTIVE' ELSE outcome END AS outcome, count(*) AS n FROM m_full GROUP BY 1")
def mg6(t):
    return mg.store_counts(t.a_snapshot_old, t.a_snapshot_new, ["external_id"], ["name", "kind"])


@query("mg4_mg5_published", "SELECT external_id, name FROM a_snapshot_new")
def mg5(t):
    root = f"{folder(t.spark)}/published-{uuid.uuid4().hex}"
    mg.publish({"stops": t.a_snapshot_old.select("external_id", "name")}, root, "v1")
    mg.publish({"stops": t.a_snapshot_new.select("external_id", "name")}, root, "v2")
    return mg.current(t.spark, root, "stops")


@query("st4_stale", "SELECT external_id FROM a_snapshot_old o WHERE NOT EXISTS (SELECT 1 FROM a_snapshot_new n WHERE n.external_id = o.external_id)")
def st4(t):
    return mg.stale(t.a_snapshot_old, t.a_snapshot_new, ["external_id"]).select("external_id")


@query("src16_sorted_json", """SELECT external_id, concat('{"kind":"', CAST(kind AS VARCHAR), '","name":"', name, '"}') AS json FROM a_snapshot_new WHERE kind IS NOT NULL""")
def src16(t):
    m = F.create_map(F.lit("name"), F.col("name"), F.lit("kind"), F.col("kind").cast("string"))
    return t.a_snapshot_new.filter("kind is not null").select("external_id", mg.sorted_json(m).alias("json"))


# ---- saved and recent journeys

NOW = "TIMESTAMP '2024-02-05 00:00:00'"


def now():
    return F.lit("2024-02-05 00:00:00").cast("timestamp")


stamped = lambda d: d.withColumn("ts", F.col("ts").cast("timestamp"))


@query("sl7_rc18_recent", f"""SELECT user_id, journey_key, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM (
 SELECT user_id, journey_key, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM a_recent WHERE ts >= {NOW} - INTERVAL 30 DAY GROUP BY user_id, journey_key) x) y WHERE place <= 10""")
def sl7(t):
    return sv.recent(stamped(t.a_recent), now(), sv.MAX_RECENT).select("user_id", "journey_key", "event_id", "place")


_CHANGE = """SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'HOME' WHEN 'purchase' THEN 'WORK' ELSE 'CUSTOM' END AS kind,
 CASE WHEN CAST(floor(value) AS BIGINT) % 23 = 1 THEN ' ' WHEN CAST(floor(value) AS BIGINT) % 29 = 1 THEN 'home' ELSE concat(' Gym  ', CAST(CAST(floor(value * 7) AS BIGINT) % 60 AS VARCHAR(20))) END AS label,
 CASE WHEN event_id % 31 = 5 THEN 'bad id!' ELSE concat('P', CAST(event_id % 97 AS VARCHAR(20))) END AS place_id FROM events"""
PARTS["s_change"] = _CHANGE
PARTS["s_slot"] = """
SELECT *, lower(clean) AS slot, CASE WHEN place_id = 'bad id!' THEN 'INVALID_PLACE' WHEN clean IS NULL THEN 'INVALID_LABEL' WHEN kind = 'CUSTOM' AND lower(clean) IN ('home', 'work') THEN 'LABEL_TAKEN' END AS bad
FROM (SELECT *, CASE kind WHEN 'HOME' THEN 'Home' WHEN 'WORK' THEN 'Work' ELSE NULLIF(trim(regexp_replace(label, '\\s+', ' ', 'g')), '') END AS clean FROM s_change) x"""
PARTS["s_in"] = """
SELECT user_id, slot, first_id FROM (SELECT user_id, slot, min(event_id) AS first_id, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS n FROM s_slot WHERE bad IS NULL GROUP BY user_id, slot) x WHERE n <= 20"""
PARTS["s_result"] = """
SELECT s.event_id, s.user_id, s.clean, s.place_id, CASE WHEN bad IS NOT NULL THEN bad WHEN kind = 'CUSTOM' AND s.event_id > i.first_id THEN 'LABEL_TAKEN' WHEN i.slot IS NULL THEN 'LIMIT' ELSE 'OK' END AS result
FROM s_slot s LEFT JOIN s_in i ON i.user_id = s.user_id AND i.slot = s.slot"""


@query("rc17_place_changes", "SELECT event_id, user_id, clean, result FROM s_result")
def rc17(t):
    return sv.place_changes(t.sql(_CHANGE), sv.MAX_SAVED, sv.MAX_LABEL)


@query("rc17_saved_places", "SELECT user_id, clean AS label, arg_max(place_id, event_id) AS place_id FROM s_result WHERE result = 'OK' GROUP BY user_id, clean")
def rc17_places(t):
    ch = t.sql(_CHANGE)
    return sv.saved_places(ch, sv.place_changes(ch, sv.MAX_SAVED, sv.MAX_LABEL))


PARTS["s_off"] = """
SELECT r.*, CASE WHEN i.journey_key IS NULL THEN 'LIMIT' ELSE 'OK' END AS result FROM a_recent r LEFT JOIN (SELECT user_id, journey_key FROM (
 SELECT user_id, journey_key, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS n FROM a_recent GROUP BY user_id, journey_key) x WHERE n <= 10) i ON i.user_id = r.user_id AND i.journey_key = r.journey_key"""


@query("rc19_offline_changes", "SELECT event_id, user_id, journey_key, result FROM s_off")
def rc19(t):
    return sv.offline_changes(stamped(t.a_recent), sv.MAX_OFFLINE).drop("ts")


@query("rc19_offline_journeys", f"SELECT user_id, journey_key, max(ts) >= {NOW} - INTERVAL 30 DAY AS named FROM s_off WHERE result = 'OK' GROUP BY user_id, journey_key")
def rc19_journeys(t):
    return sv.offline_journeys(sv.offline_changes(stamped(t.a_recent), sv.MAX_OFFLINE), now()).drop("saved_at")


@query("fn18_rc21_freshness", """SELECT event_id AS id, ts <= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 7 DAY AS saved_stale, TIMESTAMP '2024-01-31 12:00:00' > CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 10 DAY + to_seconds(86399) - to_minutes(330) AS service_ended,
 CASE WHEN user_id % 4 = 0 THEN false ELSE ts - INTERVAL 160 DAY <= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 180 DAY END AS dataset_old, user_id % 4 = 0 AS dataset_age_unknown FROM events""")
def fn18(t):
    ts = F.col("ts").cast("timestamp")
    d = t.events.select(F.col("event_id").alias("id"), ts.alias("saved_at"), F.date_add(F.to_date(ts), 10).alias("service_end"),
                        F.when(F.col("user_id") % 4 != 0, ts - F.make_dt_interval(days=F.lit(160))).alias("imported_at"))
    return sv.freshness(d, F.lit("2024-01-31 12:00:00").cast("timestamp"))


@query("fn17_labels", """SELECT doc_id, CASE WHEN length(l) >= 1 THEN l END AS label, regexp_full_match(source, '[A-Za-z0-9_-]+') AS place_id
FROM (SELECT doc_id, source, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F-\\x9F]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS l FROM documents) x""")
def fn17(t):
    return t.documents.select("doc_id", tx.clean_label(F.col("text")).alias("label"), tx.is_place_id(F.col("source")).alias("place_id"))


_DOC = """SELECT event_id AS doc_id, CASE WHEN event_id % 13 = 1 THEN NULL WHEN event_id % 17 = 1 THEN 'not json' ELSE concat(chr(123), '"version":', CASE WHEN event_id % 11 = 1 THEN '2' ELSE '1' END, ',"saved":[',
 chr(123), '"id":"a","kind":"', CASE WHEN user_id % 5 = 0 THEN 'SHOP' ELSE 'HOME' END, '","label":"x","placeId":"P1","savedAt":1700000000000', chr(125), ',',
 chr(123), '"id":"b","kind":"CUSTOM","label":"', CASE WHEN user_id % 3 = 0 THEN '  ' ELSE 'Gym' END, '","placeId":"', CASE WHEN user_id % 7 = 0 THEN 'no good' ELSE 'P2' END, '","savedAt":1700000000000', chr(125), '],"recent":[]', chr(125)) END AS raw, user_id FROM events"""
PARTS["s_doc"] = _DOC


@query("src21_place_documents", """SELECT doc_id, CASE WHEN raw IS NULL THEN 'empty' WHEN raw = 'not json' OR doc_id % 11 = 1 THEN 'discarded' ELSE 'ok' END AS status,
 CAST(CASE WHEN raw IS NULL OR raw = 'not json' OR doc_id % 11 = 1 THEN 0 ELSE CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN user_id % 3 = 0 OR user_id % 7 = 0 THEN 1 ELSE 0 END END AS BIGINT) AS dropped FROM s_doc""")
def src21(t):
    return sv.parse_places(t.sql(_DOC), 1_710_000_000_000).drop("saved")


_PREF = """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 13 = 1 THEN NULL WHEN o_orderkey % 17 = 1 THEN '[1]' ELSE concat(chr(123), '"version":', CASE WHEN o_orderkey % 11 = 1 THEN '3' ELSE '1' END, ',"prefer":', chr(123), '"fastest":',
 CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"lessWalking":', CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END, chr(125), ',"avoid":["TRAIN","', CASE WHEN o_orderkey % 5 = 0 THEN 'BOAT' ELSE 'BUS' END, '","TRAIN"]', chr(125)) END AS raw FROM orders"""
PARTS["s_pref"] = _PREF


@query("rc23_preference_documents", """SELECT doc_id, CASE WHEN raw IS NULL THEN 'empty' WHEN raw = '[1]' OR doc_id % 11 = 1 THEN 'discarded' ELSE 'ok' END AS status,
 CASE WHEN raw IS NULL OR raw = '[1]' OR doc_id % 11 = 1 THEN '' ELSE concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'fastest' END, CASE WHEN doc_id % 3 = 0 THEN 'lessWalking' END) END AS prefer,
 CASE WHEN raw IS NULL OR raw = '[1]' OR doc_id % 11 = 1 THEN '' WHEN doc_id % 5 = 0 THEN 'TRAIN' ELSE 'BUS,TRAIN' END AS avoid FROM s_pref""")
def rc23(t):
    return sv.parse_preferences(t.sql(_PREF))
