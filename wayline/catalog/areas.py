"""Area import, provider responses, polylines, feed scans and area quality."""

import uuid

from pyspark.sql import functions as F

from wayline.functions.geo import EARTH, point_segment, wrapped
from wayline.operators import constraints as cn
from wayline.operators.stage import folder, stage
from wayline.plans import areas as ar, bus_quality as q, detect as dt
from wayline.registry import PARTS, query
from wayline.sources import gtfs, polyline as pl, provider as pv

PARTS["o_class"] = """
SELECT *, trim(regexp_replace(coalesce(name, ''), '\\s+', ' ', 'g')) AS clean, CASE WHEN base IN ('SUBURB', 'LOCALITY') AND regexp_matches(trim(coalesce(name, '')), '(?i)^sector[\\s-]*\\d+[a-z]?$') THEN 'SECTOR' ELSE base END AS area_type,
 CASE WHEN amenity IS NOT NULL THEN 'EXCLUDED_FEATURE' WHEN place IS NOT NULL AND base IS NULL THEN 'UNMAPPED_PLACE' WHEN boundary = 'administrative' AND place IS NULL AND base IS NULL THEN 'UNMAPPED_ADMIN_LEVEL'
  WHEN base IS NULL OR kind = 'node' THEN 'UNMAPPED_TAGS' END AS skipped FROM (
 SELECT *, CASE WHEN place IS NOT NULL THEN CASE place WHEN 'city' THEN 'CITY' WHEN 'town' THEN 'TOWN' WHEN 'village' THEN 'VILLAGE' WHEN 'hamlet' THEN 'LOCALITY' WHEN 'suburb' THEN 'SUBURB' WHEN 'quarter' THEN 'SUBURB' WHEN 'neighbourhood' THEN 'LOCALITY' END
  WHEN boundary = 'administrative' THEN CASE try_cast(admin_level AS INT) WHEN 6 THEN 'DISTRICT' WHEN 7 THEN 'MUNICIPALITY' WHEN 8 THEN 'MUNICIPALITY' WHEN 9 THEN 'LOCALITY' WHEN 10 THEN 'LOCALITY' END END AS base FROM a_osm) x"""


def tagged(t):
    keys = ["place", "boundary", "admin_level", "amenity", "name"]
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys]), lambda e: e["value"].isNotNull())
    return t.a_osm.select("osm_id", "kind", F.map_from_entries(pairs).alias("tags"))


@query("ai1_ai2_ai3_classified", "SELECT osm_id, area_type, skipped, CASE WHEN skipped IS NULL AND clean = '' THEN 'NO_NAME' END AS rejected, clean FROM o_class")
def ai1(t):
    return ar.classify(tagged(t)).select("osm_id", "area_type", "skipped", "rejected", "clean")


@query("ai7_import_counts", "SELECT coalesce(skipped, CASE WHEN clean = '' THEN 'NO_NAME' ELSE area_type END) AS what, count(*) AS n FROM o_class GROUP BY 1")
def ai7(t):
    return ar.classify(tagged(t)).groupBy(F.coalesce("skipped", "rejected", "area_type").alias("what")).agg(F.count(F.lit(1)).alias("n"))


PARTS["o_stored"] = "SELECT p_partkey AS area_id FROM part WHERE p_retailprice < 1900 OR p_size > 3"
PARTS["o_claims"] = "SELECT child, count(DISTINCT parent) AS n, min(parent) AS parent FROM a_claim WHERE child IN (SELECT area_id FROM o_stored) GROUP BY child"
PARTS["o_single"] = "SELECT child, parent FROM o_claims WHERE n = 1 AND parent IN (SELECT area_id FROM o_stored)"
PARTS["o_chain"] = """
WITH RECURSIVE up AS (SELECT child, parent, 1 AS depth FROM o_single UNION ALL SELECT u.child, s.parent, u.depth + 1 FROM up u JOIN o_single s ON s.child = u.parent WHERE u.depth < 65) SELECT * FROM up"""


def stored(t):
    return t.part.filter("p_retailprice < 1900 or p_size > 3").select(F.col("p_partkey").alias("area_id"))


@query("gr7_jn15_parent_links", """SELECT child, parent, CASE WHEN n > 1 THEN 'ambiguous' WHEN parent NOT IN (SELECT area_id FROM o_stored) THEN 'not imported'
 WHEN child IN (SELECT child FROM o_chain WHERE depth = 65) THEN 'ambiguous' ELSE 'linked' END AS outcome FROM o_claims""")
def gr7(t):
    return ar.parent_links(t.a_claim, stored(t))


@query("gr8_parent_cycles", "SELECT DISTINCT child AS area_id FROM o_chain WHERE child = parent AND depth <= 64")
def gr8(t):
    single = (t.a_claim.join(stored(t).withColumnRenamed("area_id", "child"), "child", "left_semi").groupBy("child")
              .agg(F.countDistinct("parent").alias("n"), F.min("parent").alias("parent")).filter("n = 1").drop("n"))
    return ar.in_parent_cycle(stage(single.join(stored(t).withColumnRenamed("area_id", "parent"), "parent", "left_semi")))


@query("ag13_dq2_area_sizes", "SELECT area_type, count(*) AS areas, round(avg(size_m), 2) AS avg_size_m, round(min(size_m), 2) AS min_size_m, round(max(size_m), 2) AS max_size_m FROM g_area GROUP BY area_type")
def ag13(t):
    d = t.a_rect.filter("area_type <> 'OTHER'")
    box = dt.boxes(dt.rectangle_edges(d)).join(d.select("area_id", "area_type"), "area_id")
    two = lambda f, n: F.round(f("size_m"), 2).alias(n)
    return box.groupBy("area_type").agg(F.count(F.lit(1)).alias("areas"), two(F.avg, "avg_size_m"), two(F.min, "min_size_m"), two(F.max, "max_size_m"))


@query("dq1_area_checks", """
SELECT 'missing name' AS check_name, count(*) AS n FROM a_osm WHERE trim(coalesce(name, '')) = ''
UNION ALL SELECT 'stray whitespace', count(*) FROM a_osm WHERE name <> trim(name) OR regexp_matches(name, '\\s{2,}')
UNION ALL SELECT 'parent missing', count(*) FROM a_claim c WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = c.parent)
UNION ALL SELECT 'own parent', count(*) FROM a_claim WHERE child = parent
UNION ALL SELECT 'duplicate identity', count(*) FROM (SELECT child FROM a_claim GROUP BY child HAVING count(*) > 1) d""")
def dq1(t):
    name = F.col("name")
    a = q.flags(t.a_osm, {"missing name": F.trim(F.coalesce(name, F.lit(""))) == "", "stray whitespace": (name != F.trim(name)) | name.rlike(r"\s{2,}")})
    lost = t.a_claim.join(t.part.select(F.col("p_partkey").alias("parent")), "parent", "left_anti")
    return a.unionByName(q.flags(t.a_claim, {"own parent": F.col("child") == F.col("parent")})).unionByName(
        cn.violations({"parent missing": lost, "duplicate identity": cn.not_unique(t.a_claim, "child")}))


@query("ag14_dq2_repeated_names", "SELECT lower(trim(name)) AS name, area_type, count(*) AS records FROM a_rect GROUP BY 1, 2 HAVING count(*) > 1")
def ag14(t):
    return cn.not_unique(t.a_rect.withColumn("name", F.lower(F.trim("name"))), "name", "area_type")


# ---- polylines

@query("src11_src12_round_trip", "SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS seq, round(floor(lat * 1e5 + 0.5e0) / 1e5, 5) AS lat, round(floor(lon * 1e5 + 0.5e0) / 1e5, 5) AS lon FROM a_vertex WHERE route_id IN (SELECT route_id FROM g_seg)")
def src11(t):
    pts, _ = pl.decode(stage(pl.encode(t.a_vertex)))
    return pts.select("route_id", "seq", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("src11_rejected", "SELECT route_id, CASE WHEN count(*) < 2 THEN 'TOO_FEW_POINTS' ELSE 'NO_LENGTH' END AS reason FROM a_vertex WHERE route_id NOT IN (SELECT route_id FROM g_seg) GROUP BY route_id")
def src11_rejected(t):
    return pl.decode(stage(pl.encode(t.a_vertex)))[1]


@query("src15_wkt", "SELECT route_id, concat('LINESTRING(', string_agg(concat(CAST(CAST(seq AS DOUBLE) AS VARCHAR), ' ', CAST(seq / 2e0 AS VARCHAR)), ',' ORDER BY seq), ')') AS wkt FROM a_vertex GROUP BY route_id")
def src15(t):
    return pl.wkt(t.a_vertex.select("route_id", "seq", F.col("seq").cast("double").alias("lon"), (F.col("seq") / 2).alias("lat")))


@query("jn21_geo14_routes_near_point", """
SELECT r.request_id, s.route_id, round(min(sqrt(pow(px + f * dx, 2) + pow(py + f * dy, 2))), 2) AS meters, min(sqrt(pow(px + f * dx, 2) + pow(py + f * dy, 2))) <= 500 AS passes FROM (
 SELECT *, greatest(0e0, least(1e0, -(px * dx + py * dy) / (dx * dx + dy * dy))) AS f FROM (
  SELECT r.request_id, s.route_id, radians(s.ax - r.from_lon) * 6371008.8e0 * cos(radians(r.from_lat)) AS px, radians(s.ay - r.from_lat) * 6371008.8e0 AS py,
   radians(s.bx - s.ax) * 6371008.8e0 * cos(radians(r.from_lat)) AS dx, radians(s.bz - s.ay) * 6371008.8e0 AS dy FROM a_request r JOIN g_seg s ON CAST(floor(s.route_id / 10) AS BIGINT) = r.request_id) x) s
JOIN a_request r ON r.request_id = s.request_id GROUP BY r.request_id, s.route_id""")
def jn21(t):
    seg = dt.segments(t.a_vertex).withColumn("request_id", F.floor(F.col("route_id") / 10))
    d = seg.join(t.a_request.select("request_id", "from_lat", "from_lon"), "request_id")
    k = F.cos(F.radians("from_lat"))
    X = lambda c: F.radians(wrapped(F.col(c) - F.col("from_lon"))) * EARTH * k
    Y = lambda c: F.radians(F.col(c) - F.col("from_lat")) * EARTH
    dist = point_segment(F.lit(0.0), F.lit(0.0), X("ax"), Y("ay"), X("bx"), Y("by"))
    return d.groupBy("request_id", "route_id").agg(F.round(F.min(dist), 2).alias("meters"), (F.min(dist) <= 500).alias("passes"))


# ---- provider responses and feed scans

_RESP = """SELECT o_orderkey AS response_id, concat(chr(123), '"routes":[', chr(123), '"duration":"', CASE WHEN o_orderkey % 13 = 1 THEN 'soon' ELSE concat(CAST(o_custkey AS VARCHAR(20)), '.5s') END, '",',
 CASE WHEN o_orderkey % 7 = 1 THEN '' ELSE concat('"distanceMeters":', CAST(o_custkey * 3 AS VARCHAR(20)), ',') END, CASE WHEN o_orderkey % 17 = 1 THEN '' ELSE concat('"polyline":', chr(123), '"encodedPolyline":"abc"', chr(125), ',') END,
 '"warnings":["a"," ","b"],"travelAdvisory":', chr(123), '"transitFare":', chr(123), '"currencyCode":"', CASE WHEN o_orderkey % 5 = 1 THEN 'inr' ELSE 'INR' END, '","units":"', CAST(o_custkey % 40 AS VARCHAR(20)), '","nanos":500000000', chr(125), chr(125),
 ',"legs":[', chr(123), '"steps":[', chr(123), '"travelMode":"WALK","distanceMeters":120,"staticDuration":"90s"', chr(125), ',', chr(123), '"travelMode":"TRANSIT","distanceMeters":900,"transitDetails":', chr(123), '"stopCount":', CAST(o_orderkey % 4 AS VARCHAR(20)),
 ',"stopDetails":', chr(123), '"departureStop":', chr(123), '"name":" A ","location":', chr(123), '"latLng":', chr(123), '"latitude":', CASE WHEN o_orderkey % 11 = 1 THEN '95.0' ELSE '28.5' END, ',"longitude":77.25', chr(125), chr(125), chr(125), ',"arrivalStop":', chr(123), '"name":"B"', chr(125), chr(125),
 ',"transitLine":', chr(123), '"name":"', CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE 'Blue Line' END, '","nameShort":"BL","vehicle":', chr(123), '"type":"SUBWAY"', chr(125), chr(125), chr(125), chr(125), ']', chr(125), ']', chr(125), ']', chr(125)) AS raw FROM orders"""
PARTS["v_order"] = "SELECT o_orderkey AS response_id, o_custkey, o_orderkey % 13 = 1 AS bad_time, o_orderkey % 17 = 1 AS bad_line FROM orders"


@query("src8_src10_routes", """SELECT response_id, CASE WHEN response_id % 7 = 1 THEN 0 ELSE o_custkey * 3 END AS distance_m, CASE WHEN NOT bad_time THEN o_custkey + 1 END AS duration_s, CAST(2 AS BIGINT) AS warnings,
 CASE WHEN response_id % 5 <> 1 THEN o_custkey % 40 + 0.5e0 END AS fare, CASE WHEN bad_time THEN 'duration is missing or malformed' WHEN bad_line THEN 'polyline is missing' END AS reason FROM v_order""")
def src8(t):
    return pv.routes(t.sql(_RESP)).select("response_id", "distance_m", "duration_s", "warnings", "fare", "reason")


@query("src9_steps", """SELECT response_id, CAST(s AS BIGINT) AS seq, CASE s WHEN 0 THEN 'WALK' ELSE 'RIDE' END AS kind, CASE s WHEN 0 THEN '' ELSE CASE WHEN response_id % 3 = 1 THEN 'BL' ELSE 'Blue Line' END END AS line,
 CASE s WHEN 0 THEN '' ELSE 'A' END AS from_stop, CASE s WHEN 0 THEN CAST(0 AS BIGINT) ELSE response_id % 4 END AS stop_count, CASE WHEN s = 1 AND response_id % 11 <> 1 THEN 28.5e0 END AS from_lat
FROM v_order JOIN (SELECT 0 AS s UNION ALL SELECT 1) k ON true WHERE NOT bad_time AND NOT bad_line""")
def src9(t):
    return pv.steps(pv.routes(t.sql(_RESP))).select("response_id", "seq", "kind", "line", "from_stop", "stop_count", "from_lat")


@query("src9_transit_totals", "SELECT response_id, CAST(1 AS BIGINT) AS rides, CAST(0 AS BIGINT) AS transfers, CAST(120 AS BIGINT) AS walking_m, 'A' AS first_stop, 'B' AS last_stop FROM v_order WHERE NOT bad_time AND NOT bad_line")
def src9_totals(t):
    return pv.transit_totals(pv.steps(pv.routes(t.sql(_RESP)))).drop("idx")


@query("src1_src2_feed_scan", "SELECT trip_id, route_id, service_id, trim(trip_headsign) AS trip_headsign, '' AS block_id FROM raw_trip")
def src1(t):
    path = f"{folder(t.spark)}/feed-{uuid.uuid4().hex}/trips"
    t.raw_trip.select("trip_id", "route_id", "service_id", "trip_headsign").write.mode("overwrite").csv(path, header=True, escape='"', quote='"')
    return gtfs.table(t.spark, path, ["trip_id", "route_id", "service_id"], ["trip_headsign", "block_id"]).drop("row_pos")


# ---- import: repeated ids, lookups, regions

PARTS["o_source"] = "SELECT p_partkey AS row_pos, p_size AS external_id, p_brand AS source, p_size * 7 % 40 AS source_id FROM part"


@query("ai5_repeated_ids", "SELECT row_pos, external_id, row_pos > min(row_pos) OVER (PARTITION BY external_id) AS duplicate FROM o_source")
def ai5(t):
    d = t.part.select(F.col("p_partkey").alias("row_pos"), F.col("p_size").alias("external_id"))
    return ar.repeated_ids(d, "row_pos")


@query("src20_areas_of_source", "SELECT row_pos, source, source_id FROM o_source WHERE source = 'Brand#11' AND source_id IN (SELECT n_nationkey FROM nation)")
def src20(t):
    d = t.part.select(F.col("p_partkey").alias("row_pos"), F.col("p_brand").alias("source"), (F.col("p_size") * 7 % 40).cast("bigint").alias("source_id"))
    return ar.find_area(d, "Brand#11", t.nation.select(F.col("n_nationkey").cast("bigint").alias("source_id"))).select("row_pos", "source", "source_id")


PARTS["o_region"] = """
SELECT p_partkey AS request_id, p_partkey % 8 AS kind, 10 + p_partkey % 50 AS s, p_partkey % 90 AS w FROM part"""
PARTS["o_region_text"] = """
SELECT *, CASE kind WHEN 0 THEN '' WHEN 1 THEN concat(s, ',', w, ',', s + 1) WHEN 2 THEN concat(s, ',', w, ',north,', w + 1) WHEN 3 THEN concat(s, ',', w, ',', s + 90, ',', w + 1) WHEN 4 THEN concat(s, ',', w, ',', s, ',', w + 1)
 WHEN 5 THEN concat(s, ',', w, ',', s + 1, ',', w + 9) ELSE concat(' ', s, ' , ', w, ',', s + 1, ',', w + 2) END AS text FROM o_region"""


@query("ai6_regions", """SELECT request_id, CASE kind WHEN 0 THEN 'MISSING' WHEN 1 THEN 'NOT_FOUR_NUMBERS' WHEN 2 THEN 'NOT_A_NUMBER' WHEN 3 THEN 'OUT_OF_RANGE' WHEN 4 THEN 'EMPTY' WHEN 5 THEN 'TOO_WIDE' END AS problem,
 CASE WHEN kind > 5 THEN CAST(s AS DOUBLE) END AS south, CASE WHEN kind > 5 THEN CAST(w + 2 AS DOUBLE) END AS east FROM o_region_text""")
def ai6(t):
    s, w = 10 + F.col("p_partkey") % 50, F.col("p_partkey") % 90
    text = lambda *x: F.concat(*[y.cast("string") if hasattr(y, "cast") else F.lit(y) for y in x])
    kinds = [F.lit(""), text(s, ",", w, ",", s + 1), text(s, ",", w, ",north,", w + 1), text(s, ",", w, ",", s + 90, ",", w + 1), text(s, ",", w, ",", s, ",", w + 1), text(s, ",", w, ",", s + 1, ",", w + 9),
             text(" ", s, " , ", w, ",", s + 1, ",", w + 2)]
    said = F.element_at(F.array(*kinds), F.least(F.col("p_partkey") % 8, F.lit(6)).cast("int") + 1)
    d = t.part.select(F.col("p_partkey").alias("request_id"), ar.region(said, 5.0).alias("r"))
    ok = lambda c: F.when(F.col("r.problem").isNull(), F.col(f"r.{c}")).alias(c)
    return d.select("request_id", "r.problem", ok("south"), ok("east"))
