"""Comparison of the route alternatives of many search sessions: area search, badges, preferences, accessibility."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayline.functions import scalars as s, text as tx
from wayline.operators.accept import reasons
from wayline.operators.ordered import running_sum
from wayline.operators.stage import stage

QUALITY = {"exact": 0, "prefix": 1, "contains": 2}
TRAVEL_MODES = ["TWO_WHEELER", "FOUR_WHEELER", "BUS", "METRO", "TRAIN", "WALKING", "CYCLING"]
SINGLE_LEG = ["TWO_WHEELER", "FOUR_WHEELER", "WALKING", "CYCLING"]
TIERS = {"ALL_LISTED": 0, "PARTIAL": 1, "UNKNOWN": 2, "HAS_INACCESSIBLE": 3}


def lookup(c: Column, table: dict) -> Column:
    return reduce(lambda a, kv: a.when(c == kv[0], F.lit(kv[1])), list(table.items())[1:],
                  F.when(c == list(table)[0], F.lit(table[list(table)[0]])))


def area_key(name: Column, area_type: Column) -> Column:
    """Identity of a place across routes."""
    return F.concat(tx.search_name(name), F.lit("|"), area_type)


# ---- passing-area search

def search_term(raw: Column) -> Column:
    return tx.search_name(raw)


def area_hits(searches: DataFrame, areas: DataFrame) -> DataFrame:
    """One row per session, matching place and route: the first occurrence on that route."""
    d = (searches.withColumn("term", search_term(F.col("query"))).filter("term <> ''").join(areas, "session_id")
         .withColumn("clean", tx.search_name(F.col("name")))
         .withColumn("quality", tx.match_quality(F.col("clean"), F.col("term"))).filter("quality is not null")
         .withColumn("key", F.concat("clean", F.lit("|"), "area_type")))
    return (d.groupBy("session_id", "key", "route_id", "idx", "quality", "area_type")
            .agg(F.min_by(F.struct("area_id", "name"), "sequence").alias("first"))
            .select("session_id", "key", "route_id", "idx", "quality", "area_type", "first.area_id", "first.name"))


def search_results(hits: DataFrame, selected: DataFrame) -> DataFrame:
    """Ranked places of each session, leaving out what is already selected (by key or by id)."""
    by_id = hits.join(selected.select("session_id", "area_id").distinct(), ["session_id", "area_id"], "left_semi")
    free = (hits.join(selected.select("session_id", "key").distinct(), ["session_id", "key"], "left_anti")
            .join(by_id.select("session_id", "key").distinct(), ["session_id", "key"], "left_anti"))
    per = free.groupBy("session_id", "key", "quality", "area_type").agg(
        F.min_by(F.struct("area_id", "name"), "idx").alias("first"), F.min("idx").alias("first_idx"),
        F.countDistinct("route_id").alias("routes"))
    order = W.partitionBy("session_id").orderBy(lookup(F.col("quality"), QUALITY), "first_idx", "key")
    return per.select("session_id", "key", "quality", "area_type", "first.area_id", "first.name", "first_idx", "routes",
                      F.row_number().over(order).alias("rank"))


def search_outcome(searches: DataFrame, options: DataFrame, results: DataFrame) -> DataFrame:
    has = options.select("session_id").distinct().withColumn("has_routes", F.lit(True))
    n = results.groupBy("session_id").agg(F.count(F.lit(1)).alias("found"))
    status = reasons((F.col("has_routes").isNull(), "no-routes"), (search_term(F.col("query")) == "", "empty-query"),
                     (F.col("found").isNull(), "no-match"))
    return (searches.join(has, "session_id", "left").join(n, "session_id", "left")
            .select("session_id", F.coalesce(status, F.lit("found")).alias("status")))


def matched_by_route(hits: DataFrame, results: DataFrame) -> DataFrame:
    """Matched places of each route, in the order they were found."""
    order = W.partitionBy("route_id").orderBy("rank")
    return (hits.join(results.select("session_id", "key", "rank"), ["session_id", "key"])
            .select("route_id", "area_id", F.row_number().over(order).alias("place")))


def prune_selected(selected: DataFrame, areas: DataFrame) -> DataFrame:
    """Selected places that exist in the session by key or by id."""
    known = areas.select("session_id", area_key(F.col("name"), F.col("area_type")).alias("key"), "area_id")
    by_key = selected.join(known.select("session_id", "key").distinct(), ["session_id", "key"], "left_semi")
    by_id = selected.join(known.select("session_id", "area_id").distinct(), ["session_id", "area_id"], "left_semi")
    return by_key.unionByName(by_id).distinct()


def unique_selected(selected: DataFrame) -> DataFrame:
    """Adds places in order, skipping one whose key or id is already in the list.

    The rule is order-dependent, so each session's short list is folded as an array.
    """
    item = F.struct("key", "area_id")
    one = F.array_sort(F.collect_set(item))
    seen = lambda kept, x: F.exists(kept, lambda k: (k["key"] == x["key"]) | (k["area_id"] == x["area_id"]))
    fold = lambda kept, x: F.when(seen(kept, x), kept).otherwise(F.concat(kept, F.array(x)))
    return (selected.groupBy("session_id").agg(one.alias("all"))
            .withColumn("kept", F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.slice("all", 1, 1), fold))
            .select("session_id", F.size("kept").alias("expected"), F.posexplode("kept").alias("pos", "item"))
            .select("session_id", "expected", "pos", "item.key", "item.area_id"))


def match_routes(wanted: DataFrame, areas: DataFrame) -> DataFrame:
    """Routes that contain all (complete) or some of the selected places; first occurrence of each counts."""
    a = areas.select("session_id", "route_id", "idx", "sequence", "area_id", area_key(F.col("name"), F.col("area_type")).alias("key"))
    w = wanted.select("session_id", "expected", "pos", "key", "area_id")
    keep = ["session_id", "route_id", "idx", "expected", "pos", "sequence", F.col("hit_id")]
    by_key = a.withColumn("hit_id", F.col("area_id")).drop("area_id").join(w.drop("area_id"), ["session_id", "key"]).select(*keep)
    by_id = a.withColumn("hit_id", F.col("area_id")).drop("key").join(w.drop("key"), ["session_id", "area_id"]).select(*keep)
    first = (by_key.unionByName(by_id).groupBy("session_id", "route_id", "idx", "expected", "pos")
             .agg(F.min_by("hit_id", "sequence").alias("area_id"), F.min("sequence").alias("sequence")))
    # One entry per distinct matched area; their number is bounded by the selection.
    return (first.groupBy("session_id", "route_id", "idx", "expected")
            .agg(F.count(F.lit(1)).alias("found"), F.array_sort(F.collect_set(F.struct("sequence", "area_id"))).alias("m"))
            .select("session_id", "route_id", "idx", "expected", "found", (F.col("found") == F.col("expected")).alias("complete"),
                    F.array_join(F.transform("m", lambda x: x["area_id"].cast("string")), ",").alias("areas")))


def timeline(areas: DataFrame, matched: DataFrame, selected: DataFrame) -> DataFrame:
    # What was matched on a route and chosen in a session travels as one array, so routes cross two shuffles, the second of which also orders them.
    m = matched.groupBy("route_id").agg(F.collect_set("area_id").alias("hits"))
    k = selected.groupBy("session_id").agg(F.collect_set("area_id").alias("picks"))
    order = W.partitionBy("route_id").orderBy("sequence", "position", "area_id")
    return (areas.join(k, "session_id", "left").withColumn("chosen", F.array_contains("picks", F.col("area_id"))).drop("picks")
            .join(m, "route_id", "left").withColumn("matched", F.array_contains("hits", F.col("area_id")))
            .select("route_id", "area_id", F.row_number().over(order).alias("place"),
                    F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("position"))).alias("position"),
                    F.coalesce("matched", F.lit(False)).alias("matched"), F.coalesce("chosen", F.lit(False)).alias("selected")))


def covering_first(options: DataFrame, matching: DataFrame) -> DataFrame:
    """Routes that cover the chosen point first, provider order otherwise."""
    hit = matching.select("route_id").distinct().withColumn("hit", F.lit(True))
    order = W.partitionBy("session_id").orderBy(F.col("covers").desc(), "idx")
    return (options.join(hit, "route_id", "left").withColumn("covers", F.coalesce("hit", F.lit(False)))
            .select("session_id", "route_id", "covers", F.row_number().over(order).alias("place")))


# ---- badges

def lowest_flags(options: DataFrame, **measures: str) -> DataFrame:
    """Flags the lowest value per session, only where there are two routes that differ; ties share the flag.

    The extremes are a map-side combined aggregate joined back, not a window, so one huge session stays cheap.
    """
    aggs = [f(c).alias(f"{k}_{n}") for n, c in measures.items() for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    per = options.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), *aggs)
    flag = lambda n, c: ((F.col("n") >= 2) & (F.col(f"n_{n}") == F.col("n")) & (F.col(f"lo_{n}") < F.col(f"hi_{n}"))
                         & (F.col(c) == F.col(f"lo_{n}")))
    return (options.join(per, "session_id")
            .select("session_id", "route_id", *[F.coalesce(flag(n, c), F.lit(False)).alias(n) for n, c in measures.items()]))


def road_badges(options: DataFrame) -> DataFrame:
    return lowest_flags(options, fastest="duration_s", shortest="distance_m")


def metro_badges(options: DataFrame) -> DataFrame:
    base = lowest_flags(options, fastest="duration_s", fewest_transfers="transfers", least_walking="walking_m", lowest_fare="fare")
    one = (options.groupBy("session_id").agg(F.min("currency").alias("a"), F.max("currency").alias("b"))
           .select("session_id", (F.col("a") == F.col("b")).alias("one_currency")))
    return (base.join(one, "session_id")
            .withColumn("lowest_fare", F.col("lowest_fare") & F.coalesce("one_currency", F.lit(False))).drop("one_currency"))


def bus_badges(options: DataFrame) -> DataFrame:
    return lowest_flags(options, fastest="duration_s", fewest_transfers="transfers", least_walking="walking_m")


def competition_rank(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """1 + rows of the key that are strictly smaller, from a histogram of values instead of a sort of all rows."""
    hist = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    below = running_sum(hist, [key], value, F.col("_n"), "_below", inclusive=False).select(key, value, (F.col("_below") + 1).alias(out))
    return df.join(below, [key, value], "left")


# ---- modes and accessibility

def modes_of(options: DataFrame, legs: DataFrame) -> DataFrame:
    """Travel modes each route is known to use, and its legs of an unknown vehicle."""
    v = s.vehicle_mode(F.col("vehicle"))
    per = legs.withColumn("m", v).groupBy("route_id").agg(
        F.collect_set(F.when(F.col("m") != "OTHER", F.col("m"))).alias("leg_modes"),
        F.count(F.when(F.col("m").isNull(), 1)).alias("unidentified"))
    return (options.join(per, "route_id", "left")
            .withColumn("modes", F.array_sort(F.array_union(F.array("mode"), F.coalesce("leg_modes", F.array().cast("array<string>")))))
            .withColumn("unidentified", F.coalesce("unidentified", F.lit(0))).drop("leg_modes"))


def access_points(listed: DataFrame) -> DataFrame:
    """One row per route and stop: what was listed first, a change when it was listed in two ways."""
    return (listed.groupBy("session_id", "route_id", "stop_key")
            .agg(F.min_by("status", "ord").alias("status"),
                 F.when(F.min("kind") != F.max("kind"), "TRANSFER").otherwise(F.min("kind")).alias("kind")))


def access_levels(points: DataFrame) -> DataFrame:
    ok, bad = F.col("status") == "ACCESSIBLE", F.col("status") == "INACCESSIBLE"
    return (points.groupBy("session_id", "route_id")
            .agg(F.count(F.when(ok, 1)).alias("accessible"), F.count(F.when(bad, 1)).alias("inaccessible"),
                 F.count(F.when(~ok & ~bad, 1)).alias("unknown"))
            .withColumn("level", F.when(F.col("inaccessible") > 0, "HAS_INACCESSIBLE").when(F.col("unknown") == 0, "ALL_LISTED")
                        .when(F.col("accessible") > 0, "PARTIAL").otherwise("UNKNOWN")))


# ---- preferences

def avoided(used: DataFrame, prefs: DataFrame) -> DataFrame:
    """Every route with its preferences and whether an avoided mode hides it."""
    return hiding(used.join(prefs, "session_id"))


def hiding(used: DataFrame) -> DataFrame:
    """Adds to routes with their modes and preferences whether an avoided mode hides them."""
    return (used.withColumn("avoid_list", F.filter(F.split("avoid", ","), lambda x: x != ""))
            .withColumn("hit", F.array_intersect("modes", "avoid_list"))
            .withColumn("hidden", F.size("hit") > 0)
            .withColumn("unverified", ~F.col("hidden") & (F.size("avoid_list") > 0) & (F.col("unidentified") > 0)))


def accessible_routes(shown: DataFrame, levels: DataFrame) -> DataFrame:
    """Remaining routes with their step-free tier; the inaccessible ones go only when another route stays."""
    d = (shown.join(levels.select("route_id", "level", F.lit(True).alias("applicable"), F.col("unknown").alias("unknown_points")),
                    "route_id", "left")
         .withColumn("applicable", F.coalesce("applicable", F.lit(False)))
         .withColumn("bad", F.col("applicable") & (F.col("level") == "HAS_INACCESSIBLE")))
    d = stage(d)
    per = d.groupBy("session_id").agg(F.count(F.lit(1)).alias("shown_n"), F.count(F.when(F.col("bad"), 1)).alias("bad_n"),
                                      F.bool_or("applicable").alias("any_applicable"))
    d = d.join(per, "session_id")
    return (d.withColumn("removes", F.col("avoid_inaccessible") & (F.col("bad_n") > 0) & (F.col("bad_n") < F.col("shown_n")))
            .withColumn("kept", ~(F.col("removes") & F.col("bad")))
            .withColumn("tier", F.when(F.col("step_free") & F.col("any_applicable"),
                                       F.when(F.col("applicable"), lookup(F.col("level"), TIERS)).otherwise(TIERS["UNKNOWN"]))))


CRITERIA = {"fastest": "duration_s", "lowest_fare": "fare", "fewer_transfers": "transfers", "less_walking": "walking_m"}


def criteria(remaining: DataFrame) -> DataFrame:
    """Status of each selected criterion per session: applied, no-difference, unavailable or not-applicable."""
    per = remaining.filter("kept").groupBy("session_id", "mode", *CRITERIA).agg(
        F.count(F.lit(1)).alias("n"), F.min("currency").alias("cur_lo"), F.max("currency").alias("cur_hi"),
        *[f(c).alias(f"{k}_{c}") for c in CRITERIA.values() for k, f in (("c", F.count), ("lo", F.min), ("hi", F.max))])
    rows = []
    for name, c in CRITERIA.items():
        comparable = (F.when(F.col("n") < 2, "no-difference").when(F.col(f"lo_{c}") == F.col(f"hi_{c}"), "no-difference")
                      .otherwise("applied"))
        full = F.when(F.col(f"c_{c}") < F.col("n"), "unavailable").otherwise(comparable)
        if name == "lowest_fare":
            status = (F.when(F.col("mode") != "METRO", "unavailable")
                      .when((F.col(f"c_{c}") == F.col("n")) & (F.col("cur_lo") != F.col("cur_hi")), "unavailable").otherwise(full))
        elif name == "fastest":
            status = full
        else:
            status = F.when(F.col("mode").isin(SINGLE_LEG), "not-applicable").otherwise(full)
        rows.append(F.when(F.col(name), F.struct(F.lit(name).alias("criterion"), status.alias("status"))))
    return (per.select("session_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r"))
            .select("session_id", "r.criterion", "r.status"))


def preferred_order(remaining: DataFrame, statuses: DataFrame) -> DataFrame:
    """Routes by access tier, then total of competition ranks over the applied criteria, then provider order."""
    remaining = remaining.filter("kept")
    used = statuses.filter("status = 'applied'").groupBy("session_id").agg(F.collect_set("criterion").alias("used"))
    d = remaining.join(used, "session_id", "left")
    total = F.lit(0)
    # Routes are gathered by session for their final order, so the ranks are taken there too; as in competition_rank, one without a value has none.
    for name, c in CRITERIA.items():
        d = d.withColumn(f"rank_{name}", F.when(F.col(c).isNotNull(), F.rank().over(W.partitionBy("session_id").orderBy(c))))
        applied = F.coalesce(F.array_contains("used", name), F.lit(False))
        total = total + F.when(applied, F.col(f"rank_{name}")).otherwise(0)
    d = d.withColumn("total", total.cast("bigint")).withColumn("tier", F.coalesce("tier", F.lit(0)))
    order = W.partitionBy("session_id").orderBy("tier", "total", "idx")
    return d.select("session_id", "route_id", "tier", "total", F.row_number().over(order).alias("place"))


def preference_report(judged: DataFrame, access: DataFrame) -> DataFrame:
    """One row per session: what was hidden, why, and what remains."""
    a = judged.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_count"), F.count(F.when(F.col("hidden"), 1)).alias("hidden_count"),
        F.count(F.when(F.col("unverified"), 1)).alias("unverified_routes"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("hidden"), F.col("hit")))))), ",").alias("hidden_modes"))
    kept = F.col("kept")
    b = access.groupBy("session_id").agg(
        F.count(F.when(kept, 1)).alias("route_count"), F.max("bad_n").alias("inaccessible_routes"),
        F.count(F.when(kept & F.col("applicable") & (F.col("level") == "ALL_LISTED"), 1)).alias("verified_routes"),
        F.count(F.when(kept & (~F.col("applicable") | (F.col("unknown_points") > 0)), 1)).alias("unknown_routes"),
        F.count(F.when(~kept, 1)).alias("hidden_inaccessible"),
        F.bool_or(F.col("avoid_inaccessible") & (F.col("bad_n") > 0) & (F.col("bad_n") == F.col("shown_n"))).alias("all_inaccessible"))
    return (a.join(b, "session_id", "left")
            .withColumn("no_match", F.col("hidden_count") == F.col("total_count"))
            .fillna(0, ["route_count", "inaccessible_routes", "verified_routes", "unknown_routes", "hidden_inaccessible"])
            .withColumn("all_inaccessible", F.coalesce("all_inaccessible", F.lit(False))))
