"""Route comparison over the session tables."""

from pyspark.sql import functions as F

from wayline.operators.stage import stage
from wayline.plans import compare as c
from wayline.registry import PARTS, query

NORM = "lower(trim(regexp_replace(trim({c}), '\\s+', ' ', 'g')))"
PARTS["c_sel"] = "SELECT session_id, concat(name_key, '|', area_type) AS key, area_id FROM a_selected"
PARTS["c_hit"] = f"""
SELECT session_id, key, route_id, idx, quality, area_type, arg_min(area_id, sequence) AS area_id, arg_min(name, sequence) AS name FROM (
 SELECT a.*, concat({NORM.format(c='a.name')}, '|', a.area_type) AS key,
   CASE WHEN {NORM.format(c='a.name')} = s.term THEN 'exact' WHEN starts_with({NORM.format(c='a.name')}, s.term) THEN 'prefix'
        WHEN contains({NORM.format(c='a.name')}, s.term) THEN 'contains' END AS quality
 FROM (SELECT session_id, {NORM.format(c='query')} AS term FROM a_search) s JOIN a_option_area a ON a.session_id = s.session_id
 WHERE s.term <> '') x WHERE quality IS NOT NULL GROUP BY session_id, key, route_id, idx, quality, area_type"""
PARTS["c_result"] = """
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE quality WHEN 'exact' THEN 0 WHEN 'prefix' THEN 1 ELSE 2 END, first_idx, key) AS rank FROM (
 SELECT h.session_id, h.key, h.quality, h.area_type, arg_min(h.area_id, h.idx) AS area_id, arg_min(h.name, h.idx) AS name, min(h.idx) AS first_idx,
        count(DISTINCT h.route_id) AS routes FROM c_hit h GROUP BY h.session_id, h.key, h.quality, h.area_type
 HAVING NOT bool_or(EXISTS (SELECT 1 FROM c_sel s WHERE s.session_id = h.session_id AND (s.key = h.key OR s.area_id = h.area_id)))) x"""
PARTS["c_wanted"] = """
SELECT session_id, len(kept) AS expected, unnest(kept).key AS key, unnest(kept).area_id AS area_id FROM (
 SELECT session_id, list_reduce(list_transform(list, lambda x: [x]), lambda k, y: CASE WHEN len(list_filter(k, lambda z: z.key = y[1].key OR z.area_id = y[1].area_id)) > 0 THEN k ELSE list_concat(k, y) END) AS kept
 FROM (SELECT session_id, list(DISTINCT {'key': key, 'area_id': area_id} ORDER BY {'key': key, 'area_id': area_id}) AS list FROM c_sel GROUP BY session_id))"""


def selected(t):
    return t.a_selected.select("session_id", F.concat("name_key", F.lit("|"), "area_type").alias("key"), "area_id")


def searched(t):
    hits = stage(c.area_hits(t.a_search, t.a_option_area))
    return hits, c.search_results(hits, selected(t))


@query("rc1_search", "SELECT session_id, key, quality, area_type, area_id, name, first_idx, routes, rank FROM c_result")
def rc1(t):
    return searched(t)[1]


@query("rc1_outcome", f"""
SELECT s.session_id, CASE WHEN NOT EXISTS (SELECT 1 FROM a_option o WHERE o.session_id = s.session_id) THEN 'no-routes'
 WHEN {NORM.format(c='s.query')} = '' THEN 'empty-query'
 WHEN NOT EXISTS (SELECT 1 FROM c_result r WHERE r.session_id = s.session_id) THEN 'no-match' ELSE 'found' END AS status FROM a_search s""")
def rc1_outcome(t):
    return c.search_outcome(t.a_search, t.a_option, searched(t)[1])


@query("rc2_matched_by_route", """
SELECT h.route_id, h.area_id, row_number() OVER (PARTITION BY h.route_id ORDER BY r.rank) AS place
FROM c_hit h JOIN c_result r ON r.session_id = h.session_id AND r.key = h.key""")
def rc2(t):
    return c.matched_by_route(*searched(t))


@query("rc3_pruned", f"""
SELECT s.* FROM c_sel s WHERE EXISTS (SELECT 1 FROM a_option_area a WHERE a.session_id = s.session_id
 AND (a.area_id = s.area_id OR concat({NORM.format(c='a.name')}, '|', a.area_type) = s.key))""")
def rc3(t):
    return c.prune_selected(selected(t), t.a_option_area)


@query("rc3_unique_selection", "SELECT session_id, CAST(expected AS BIGINT) AS expected, key, area_id FROM c_wanted")
def rc3_unique(t):
    return c.unique_selected(selected(t)).drop("pos")


@query("rc4_multi_area", f"""
SELECT session_id, route_id, idx, CAST(expected AS BIGINT) AS expected, count(*) AS found, count(*) = expected AS complete,
  (SELECT string_agg(CAST(u.area_id AS VARCHAR), ',' ORDER BY u.sequence, u.area_id) FROM (SELECT DISTINCT unnest(list(m)) AS u) z) AS areas FROM (
 SELECT a.session_id, a.route_id, a.idx, w.expected, w.key, {{'sequence': min(a.sequence), 'area_id': arg_min(a.area_id, a.sequence)}} AS m
 FROM c_wanted w JOIN a_option_area a ON a.session_id = w.session_id AND (a.area_id = w.area_id OR concat({NORM.format(c='a.name')}, '|', a.area_type) = w.key)
 GROUP BY a.session_id, a.route_id, a.idx, w.expected, w.key, w.area_id) x GROUP BY session_id, route_id, idx, expected""")
def rc4(t):
    return c.match_routes(c.unique_selected(selected(t)), t.a_option_area)


@query("jn20_full_matches", f"""
SELECT route_id FROM (SELECT a.route_id, w.expected, w.key, w.area_id FROM c_wanted w JOIN a_option_area a ON a.session_id = w.session_id
 AND (a.area_id = w.area_id OR concat({NORM.format(c='a.name')}, '|', a.area_type) = w.key) GROUP BY ALL) GROUP BY route_id, expected HAVING count(*) = expected""")
def jn20(t):
    return c.match_routes(c.unique_selected(selected(t)), t.a_option_area).filter("complete").select("route_id")


@query("rc6_timeline", """
SELECT a.route_id, a.area_id, row_number() OVER (PARTITION BY a.route_id ORDER BY a.sequence, a.position, a.area_id) AS place,
 greatest(0e0, least(1e0, a.position)) AS position, EXISTS (SELECT 1 FROM c_hit h WHERE h.route_id = a.route_id AND h.area_id = a.area_id) AS matched,
 EXISTS (SELECT 1 FROM c_sel s WHERE s.session_id = a.session_id AND s.area_id = a.area_id) AS selected FROM a_option_area a""")
def rc6(t):
    t.keep("a_line")
    return c.timeline(t.a_option_area, c.area_hits(t.a_search, t.a_option_area), selected(t))


@query("sl6_covering_first", """
SELECT session_id, route_id, l_partkey % 3 = 0 AS covers, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END, idx) AS place FROM a_option""")
def sl6(t):
    return c.covering_first(t.a_option, t.a_option.filter("l_partkey % 3 = 0"))


def low(col, extra="true"):
    return (f"count(*) OVER w >= 2 AND count({col}) OVER w = count(*) OVER w AND min({col}) OVER w < max({col}) OVER w "
            f"AND coalesce({col} = min({col}) OVER w, false) AND {extra}")


@query("rc7_road_badges", f"""SELECT session_id, route_id, {low('duration_s')} AS fastest, {low('distance_m')} AS shortest
FROM a_option WHERE mode = 'FOUR_WHEELER' WINDOW w AS (PARTITION BY session_id)""")
def rc7(t):
    return c.road_badges(t.a_option.filter("mode = 'FOUR_WHEELER'"))


@query("rc8_metro_badges", f"""SELECT session_id, route_id, {low('duration_s')} AS fastest, {low('transfers')} AS fewest_transfers, {low('walking_m')} AS least_walking,
 {low('fare', 'coalesce(min(currency) OVER w = max(currency) OVER w, false)')} AS lowest_fare FROM a_option WHERE mode = 'METRO' WINDOW w AS (PARTITION BY session_id)""")
def rc8(t):
    return c.metro_badges(t.a_option.filter("mode = 'METRO'"))


@query("rc9_bus_badges", f"""SELECT session_id, route_id, {low('duration_s')} AS fastest, {low('transfers')} AS fewest_transfers, {low('walking_m')} AS least_walking
FROM a_option WHERE mode = 'BUS' WINDOW w AS (PARTITION BY session_id)""")
def rc9(t):
    return c.bus_badges(t.a_option.filter("mode = 'BUS'"))


@query("wn6_lowest_if_different", f"SELECT session_id, route_id, {low('duration_s')} AS lowest FROM a_option WINDOW w AS (PARTITION BY session_id)")
def wn6(t):
    return c.lowest_flags(t.a_option, lowest="duration_s")


@query("wn5_competition_rank", "SELECT session_id, route_id, rank() OVER (PARTITION BY session_id ORDER BY walking_m) AS rank FROM a_option")
def wn5(t):
    return (c.competition_rank(t.a_option, "session_id", "walking_m", "rank")
            .select("session_id", "route_id", F.col("rank").cast("bigint").alias("rank")))


VM = ("CASE WHEN upper(trim(vehicle)) IN ('SUBWAY','METRO','METRO_RAIL','URBAN_RAIL') THEN 'METRO' WHEN upper(trim(vehicle)) IN ('BUS','INTERCITY_BUS','TROLLEYBUS') THEN 'BUS' "
      "WHEN upper(trim(vehicle)) IN ('HEAVY_RAIL','COMMUTER_TRAIN','HIGH_SPEED_TRAIN','LONG_DISTANCE_TRAIN','RAIL','TRAIN') THEN 'TRAIN' "
      "WHEN upper(trim(vehicle)) IN ('TRAM','LIGHT_RAIL','MONORAIL','FERRY','CABLE_CAR','GONDOLA_LIFT','FUNICULAR','SHARE_TAXI','OTHER') THEN 'OTHER' END")
PARTS["c_mode"] = f"""
SELECT o.session_id, o.route_id, list_sort(list_distinct(list_concat([o.mode], coalesce(l.ms, [])))) AS modes, coalesce(l.unidentified, 0) AS unidentified
FROM a_option o LEFT JOIN (SELECT route_id, list(DISTINCT m) FILTER (WHERE m <> 'OTHER') AS ms, count(*) FILTER (WHERE m IS NULL) AS unidentified
 FROM (SELECT route_id, {VM} AS m FROM a_leg) x GROUP BY route_id) l ON l.route_id = o.route_id"""
PARTS["c_judged"] = """
SELECT o.*, p.* EXCLUDE (session_id), m.unidentified, list_intersect(m.modes, string_split(p.avoid, ',')) AS hit, len(list_intersect(m.modes, string_split(p.avoid, ','))) > 0 AS hidden,
 len(list_intersect(m.modes, string_split(p.avoid, ','))) = 0 AND p.avoid <> '' AND m.unidentified > 0 AS unverified
FROM a_option o JOIN c_mode m ON m.route_id = o.route_id JOIN a_pref p ON p.session_id = o.session_id"""
PARTS["c_point"] = """
SELECT session_id, route_id, stop_key, arg_min(status, ord) AS status, CASE WHEN count(DISTINCT kind) > 1 THEN 'TRANSFER' ELSE min(kind) END AS kind
FROM a_access_point GROUP BY session_id, route_id, stop_key"""
PARTS["c_level"] = """
SELECT *, CASE WHEN inaccessible > 0 THEN 'HAS_INACCESSIBLE' WHEN unknown = 0 THEN 'ALL_LISTED' WHEN accessible > 0 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS level FROM (
 SELECT session_id, route_id, count(*) FILTER (WHERE status = 'ACCESSIBLE') AS accessible, count(*) FILTER (WHERE status = 'INACCESSIBLE') AS inaccessible,
        count(*) FILTER (WHERE status NOT IN ('ACCESSIBLE', 'INACCESSIBLE')) AS unknown FROM c_point GROUP BY session_id, route_id)"""
PARTS["c_access"] = """
SELECT *, NOT (avoid_inaccessible AND bad_n > 0 AND bad_n < shown_n AND bad) AS kept,
 CASE WHEN step_free AND any_applicable THEN CASE level WHEN 'ALL_LISTED' THEN 0 WHEN 'PARTIAL' THEN 1 WHEN 'HAS_INACCESSIBLE' THEN 3 ELSE 2 END END AS tier FROM (
 SELECT j.*, l.level, l.unknown AS unknown_points, l.route_id IS NOT NULL AS applicable, coalesce(l.level = 'HAS_INACCESSIBLE', false) AS bad,
   count(*) OVER w AS shown_n, count(*) FILTER (WHERE l.level = 'HAS_INACCESSIBLE') OVER w AS bad_n, bool_or(l.route_id IS NOT NULL) OVER w AS any_applicable
 FROM c_judged j LEFT JOIN c_level l ON l.route_id = j.route_id WHERE NOT j.hidden WINDOW w AS (PARTITION BY j.session_id))"""
_CMP = "CASE WHEN count({c}) < count(*) THEN 'unavailable' WHEN count(*) < 2 OR min({c}) = max({c}) THEN 'no-difference' ELSE 'applied' END"
_LEG = "mode IN ('TWO_WHEELER', 'FOUR_WHEELER', 'WALKING', 'CYCLING')"
PARTS["c_status"] = f"""
SELECT session_id, 'fastest' AS criterion, {_CMP.format(c='duration_s')} AS status FROM c_access WHERE kept AND fastest GROUP BY session_id, mode
UNION ALL SELECT session_id, 'lowest_fare', CASE WHEN mode <> 'METRO' THEN 'unavailable' WHEN count(fare) = count(*) AND count(DISTINCT currency) <> 1 THEN 'unavailable' ELSE {_CMP.format(c='fare')} END
 FROM c_access WHERE kept AND lowest_fare GROUP BY session_id, mode
UNION ALL SELECT session_id, 'fewer_transfers', CASE WHEN {_LEG} THEN 'not-applicable' ELSE {_CMP.format(c='transfers')} END FROM c_access WHERE kept AND fewer_transfers GROUP BY session_id, mode
UNION ALL SELECT session_id, 'less_walking', CASE WHEN {_LEG} THEN 'not-applicable' ELSE {_CMP.format(c='walking_m')} END FROM c_access WHERE kept AND less_walking GROUP BY session_id, mode"""
PARTS["c_order"] = """
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tier, total, idx) AS place FROM (
 SELECT session_id, route_id, idx, coalesce(tier, 0) AS tier, """ + " + ".join(
    f"CASE WHEN EXISTS (SELECT 1 FROM c_status s WHERE s.session_id = a.session_id AND s.criterion = '{n}' AND s.status = 'applied') THEN rank() OVER (PARTITION BY session_id ORDER BY {col}) ELSE 0 END"
    for n, col in c.CRITERIA.items()) + """ AS total FROM c_access a WHERE kept)"""


def judged(t):
    t.keep("a_line")
    return stage(c.avoided(c.modes_of(t.a_option, t.a_leg), t.a_pref))


def access(t, j=None):
    """``j``: judged routes that are written already; else preferences come first, so that routes meet their legs and their stops in one shuffle."""
    if j is None:
        t.keep("a_line")
        j = c.hiding(c.modes_of(t.a_option.join(t.a_pref, "session_id"), t.a_leg))
    shown = j.filter("not hidden").select("session_id", "route_id", "idx", "mode", "currency", *c.CRITERIA, *c.CRITERIA.values(), "step_free", "avoid_inaccessible")
    return c.accessible_routes(shown, c.access_levels(c.access_points(t.a_access_point)))


@query("rc10_modes", "SELECT route_id, array_to_string(modes, ',') AS modes, unidentified FROM c_mode")
def rc10(t):
    return c.modes_of(t.a_option, t.a_leg).select("route_id", F.array_join("modes", ",").alias("modes"), "unidentified")


@query("rc11_avoided", "SELECT route_id, hidden, unverified, array_to_string(list_sort(hit), ',') AS hit FROM c_judged")
def rc11(t):
    return judged(t).select("route_id", "hidden", "unverified", F.array_join(F.array_sort("hit"), ",").alias("hit"))


@query("rc12_criteria", "SELECT session_id, criterion, status FROM c_status")
def rc12(t):
    return c.criteria(access(t))


@query("rc13_ordered", "SELECT session_id, route_id, tier, CAST(total AS BIGINT) AS total, place FROM c_order")
def rc13(t):
    a = stage(access(t).select("session_id", "route_id", "idx", "mode", "currency", *c.CRITERIA, *c.CRITERIA.values(), "kept", "tier"))
    return c.preferred_order(a, c.criteria(a))


@query("rc14_accessible", "SELECT session_id, route_id, kept, tier FROM c_access")
def rc14(t):
    return access(t).select("session_id", "route_id", "kept", "tier")


@query("rc15_report", """
SELECT a.session_id, a.total_count, a.hidden_count, a.unverified_routes, a.hidden_modes, a.hidden_count = a.total_count AS no_match,
 coalesce(b.route_count, 0) AS route_count, coalesce(b.inaccessible_routes, 0) AS inaccessible_routes, coalesce(b.verified_routes, 0) AS verified_routes,
 coalesce(b.unknown_routes, 0) AS unknown_routes, coalesce(b.hidden_inaccessible, 0) AS hidden_inaccessible, coalesce(b.all_inaccessible, false) AS all_inaccessible
FROM (SELECT session_id, count(*) AS total_count, count(*) FILTER (WHERE hidden) AS hidden_count, count(*) FILTER (WHERE unverified) AS unverified_routes,
       coalesce(array_to_string(list_sort(list_distinct(flatten(list(hit) FILTER (WHERE hidden)))), ','), '') AS hidden_modes FROM c_judged GROUP BY session_id) a
LEFT JOIN (SELECT session_id, count(*) FILTER (WHERE kept) AS route_count, max(bad_n) AS inaccessible_routes,
       count(*) FILTER (WHERE kept AND level = 'ALL_LISTED') AS verified_routes, count(*) FILTER (WHERE kept AND (NOT applicable OR unknown_points > 0)) AS unknown_routes,
       count(*) FILTER (WHERE NOT kept) AS hidden_inaccessible, bool_or(avoid_inaccessible AND bad_n > 0 AND bad_n = shown_n) AS all_inaccessible FROM c_access GROUP BY session_id) b
ON b.session_id = a.session_id""")
def rc15(t):
    j = judged(t)
    return c.preference_report(j, access(t, j))


@query("rc16_access_points", "SELECT route_id, stop_key, status, kind FROM c_point")
def rc16(t):
    return c.access_points(t.a_access_point).select("route_id", "stop_key", "status", "kind")


@query("ag18_access_levels", "SELECT route_id, accessible, inaccessible, unknown, level FROM c_level")
def ag18(t):
    return c.access_levels(c.access_points(t.a_access_point)).drop("session_id")


@query("ag17_transit_totals", """
SELECT session_id, CASE WHEN bool_and(fare IS NOT NULL) THEN CAST(sum(fare) AS BIGINT) END AS fare_total, CAST(sum(walking_m) AS BIGINT) AS walking, CAST(sum(transfers + 1) AS BIGINT) AS rides, CAST(sum(transfers) AS BIGINT) AS transfers
FROM a_option GROUP BY session_id""")
def ag17(t):
    return t.a_option.groupBy("session_id").agg(
        F.when(F.bool_and(F.col("fare").isNotNull()), F.sum("fare")).alias("fare_total"), F.sum("walking_m").alias("walking"),
        F.sum(F.col("transfers") + 1).alias("rides"), F.sum("transfers").alias("transfers"))
