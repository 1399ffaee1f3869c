"""Scheduled bus journeys for a table of requests: access stops, search rounds, timetable resolution, assembly."""

from functools import cached_property, reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayline.functions.geo import haversine
from wayline.functions.scalars import half_up, walk_seconds
from wayline.operators.nearby import first_ranks, footpaths, nearest
from wayline.operators.stage import drop, stage
from wayline.plans import timetable as tt
from wayline.plans.patterns import expected_wait, usable_patterns

# Fixed values. The counts are what the interactive service asks for; no function applies one unless it is passed in.
RADII = (600, 1500)
CANDIDATES = 60
ACCESS_STOPS = 8
ROUNDS = 3
ALTERNATIVES = 3
TRANSFER_METERS = 300
SAVING = 120
BUFFER = 60
NO_ROUTE = -1
#: Numbers of 64 bits that stand for a request's goals before its rides are shuffled, and how many of the bits a stop sets.
GOAL_WORDS, GOAL_MARKS = 8, 3
LEG = "array<struct<pattern_id:string,route_id:bigint,board_idx:bigint,alight_idx:bigint,board_stop:bigint,alight_stop:bigint>>"


def settings(requests: DataFrame) -> DataFrame:
    p = F.col("preference")
    return (requests.withColumn("penalty", F.when(p == "FEWER_TRANSFERS", 900).otherwise(180))
            .withColumn("weight", F.when(p == "LESS_WALKING", 3.0).otherwise(1.5)))


class Network:
    """The searchable bus network: usable patterns, their stops, walks between stops, and what runs on which day."""

    def __init__(self, layer, stops: DataFrame, routes: DataFrame, services: DataFrame, exceptions: DataFrame,
                 days: DataFrame, positions: DataFrame):
        self._layer, self.stops, self._routes = layer, stops, routes
        self._services, self._exceptions, self._days, self._positions = services, exceptions, days, positions

    @cached_property
    def running(self) -> DataFrame:
        """Services of each wanted day and of the day before it."""
        both = self._days.select("day").unionByName(self._days.select(F.date_sub("day", 1).alias("day"))).distinct()
        return stage(tt.services_on(both, self._services, self._exceptions))

    @cached_property
    def active(self) -> DataFrame:
        usable = usable_patterns(self._layer.patterns, self._layer.stops, self.stops, self._routes).select("pattern_id")
        return stage(tt.active_patterns(self.running.join(self._days, "day", "left_semi"), self._layer.trips)
                     .join(usable, "pattern_id", "left_semi"))

    @cached_property
    def calls(self) -> DataFrame:
        """Pattern positions with the pattern's expected wait."""
        p = self._layer.patterns.select("pattern_id", expected_wait(F.col("trip_count"), F.col("first_departure"),
                                                                    F.col("last_departure")).alias("wait_s"))
        return stage(self._layer.stops.select("pattern_id", "route_id", "idx", "stop_id", "offset_s").join(p, "pattern_id"))

    @cached_property
    def serving(self) -> DataFrame:
        """Active patterns per day and stop."""
        return stage(self.calls.select("pattern_id", "stop_id").distinct().join(self.active, "pattern_id")
                     .groupBy("day", "stop_id").agg(F.count(F.lit(1)).alias("serving")))

    @cached_property
    def hops(self) -> DataFrame:
        """Best ride per day, route and pair of stops: least seconds from stop to stop (wait included), then pattern, exit and boarding position.

        What a ride costs beyond the stop it starts from does not depend on the request, so rides that another one of the same route
        always beats are left out before any request meets them. ``pattern_no`` numbers the patterns in the order of their ids.
        """
        calls = self.calls
        order = stage(calls.select("pattern_id").distinct().repartitionByRange("pattern_id").sortWithinPartitions("pattern_id")
                      .withColumn("pattern_no", F.monotonically_increasing_id()))
        on = calls.select("pattern_id", "route_id", F.col("idx").alias("board_idx"), F.col("stop_id").alias("board_stop"), (F.col("wait_s") - F.col("offset_s")).alias("_from"))
        off = calls.select("pattern_id", F.col("idx").alias("alight_idx"), "stop_id", "offset_s")
        rides = on.join(off, "pattern_id").filter("alight_idx > board_idx").join(self.active, "pattern_id").join(order, "pattern_id")
        best = F.min(F.struct((F.col("_from") + F.col("offset_s")).alias("seconds"), "pattern_no", "alight_idx", "board_idx", "pattern_id"))
        return stage(rides.groupBy("day", "board_stop", "route_id", "stop_id").agg(best.alias("h")).select("day", "board_stop", "route_id", "stop_id", "h.*"))

    @cached_property
    def walks(self) -> DataFrame:
        return stage(footpaths(self.stops.filter("active"), TRANSFER_METERS))

    @cached_property
    def departures(self) -> DataFrame:
        return stage(tt.departures(self._positions, self._layer.trips))


def nearby_stops(points: DataFrame, key: str, stops: DataFrame, serving: DataFrame, candidates: int | None = None,
                 keep: int | None = None) -> DataFrame:
    """Ranked boarding stops of each point (``day``, ``plat``, ``plon``), from the smallest radius that has any."""
    found = nearest(points, key, stops.filter("active").select("stop_id", "lat", "lon"), RADII[-1], candidates)
    fit = found.join(serving, ["day", "stop_id"]).withColumn(
        "tier", F.when(F.col("meters") <= RADII[0], 0).otherwise(1))
    best = fit.groupBy(key).agg(F.min("tier").alias("best_tier"))
    d = (fit.join(best, key).filter("tier = best_tier").withColumn("walk_s", walk_seconds(F.col("meters")))
         .withColumn("score", F.col("walk_s") + F.greatest(F.lit(0), 300 - 60 * F.least(F.col("serving"), F.lit(5)))))
    order = W.partitionBy(key).orderBy("score", "meters", "stop_id")
    return (first_ranks(d.withColumn("rank", F.row_number().over(order)), keep)
            .select(key, "stop_id", "meters", "walk_s", "serving", "score", "rank"))


def request_stops(requests: DataFrame, net: Network, candidates: int | None = None,
                  keep: int | None = None) -> tuple[DataFrame, DataFrame]:
    ends = []
    for side in ("from", "to"):
        pts = requests.select("request_id", "day", F.col(f"{side}_lat").alias("plat"), F.col(f"{side}_lon").alias("plon"))
        ends.append(stage(nearby_stops(pts, "request_id", net.stops, net.serving, candidates, keep)))
    return ends[0], ends[1]


# ---- search rounds

def start_state(requests: DataFrame, access: DataFrame) -> DataFrame:
    cost = half_up(F.col("walk_s") * F.col("weight"))
    return (access.join(requests.select("request_id", "weight"), "request_id")
            .groupBy("request_id", "stop_id").agg(F.min(cost).alias("cost"))
            .select("request_id", "stop_id", "cost", F.lit(NO_ROUTE).cast("bigint").alias("via_route"), F.lit(False).alias("by_ride"),
                    F.array().cast(LEG).alias("legs")))


def boardings(marked: DataFrame, requests: DataFrame, net: Network, banned: DataFrame | None) -> DataFrame:
    """Where an improved stop lets a request board an active pattern it did not arrive by."""
    calls = net.calls.join(net.active.distinct(), "pattern_id")
    d = marked.join(requests.select("request_id", "day", "penalty"), "request_id").join(calls, ["day", "stop_id"]).filter("via_route <> route_id")
    if banned is not None:
        d = d.join(banned, ["request_id", "route_id"], "left_anti")
    return d.select("request_id", "pattern_id", "route_id", "idx", "stop_id", "legs",
                    (F.col("cost") + F.col("wait_s") + F.col("penalty") - F.col("offset_s")).alias("base"))


def ride_arrivals(boards: DataFrame, net: Network) -> DataFrame:
    """Cheapest arrival at every later position of each boarded pattern; the earliest boarding wins ties.

    The boardings of a request on one pattern, as few as the pattern has stops, travel as one array; the row per later position is made after the last shuffle.
    """
    on = boards.groupBy("request_id", "pattern_id").agg(F.collect_list(F.struct("base", "idx", F.col("stop_id").alias("board_stop"), "legs")).alias("on"))
    calls = net.calls.groupBy("pattern_id", "route_id", "idx", "stop_id", "offset_s").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    line = on.withColumn("from_idx", F.array_min("on.idx")).join(calls, "pattern_id").filter("idx >= from_idx and request_id is not null")
    # A position that is listed more than once has a row per copy and boarding there; all but one of them also follow the boarding there.
    up_to = lambda i: F.array_min(F.filter("on", lambda x: x["idx"] < i))
    rows = F.col("copies") * F.greatest(F.lit(1), F.size(F.filter("on", lambda x: x["idx"] == F.col("idx"))))
    here = F.when(rows > 1, F.array_repeat(up_to(F.col("idx") + 1), rows - 1)).otherwise(F.array())
    best = line.withColumn("best", F.explode(F.concat(F.array(up_to(F.col("idx"))), here))).filter("best is not null")
    leg = F.struct("pattern_id", "route_id", F.col("best.idx").alias("board_idx"), F.col("idx").alias("alight_idx"),
                   F.col("best.board_stop").alias("board_stop"), F.col("stop_id").alias("alight_stop"))
    return best.select("request_id", "stop_id", (F.col("best.base") + F.col("offset_s")).alias("cost"), "pattern_id", "idx",
                       F.col("route_id").alias("via_route"), F.concat(F.col("best.legs"), F.array(leg)).cast(LEG).alias("legs"))


def best_rides(marked: DataFrame, requests: DataFrame, totals: DataFrame, net: Network, banned: DataFrame | None, goals: DataFrame | None) -> DataFrame:
    """Cheapest arrival per request and stop by one more ride: the least of ``ride_arrivals``, with the same ties.

    Only numbers travel to the request's stops; the legs are read again for the rides that are left. ``goals``: the only stops asked for. Most rides
    lead elsewhere, so before they are shuffled a ride is asked for the bits its stop sets among those of the request's goals; what is left meets the goals themselves.
    """
    at = (marked.select("request_id", F.col("stop_id").alias("board_stop"), "cost", "via_route").join(requests.select("request_id", "day", "penalty"), "request_id")
          .join(totals.select("request_id", "best_total"), "request_id", "left"))
    if banned is not None:  # as many routes as searches before this one
        at = at.join(banned.groupBy("request_id").agg(F.collect_set("route_id").alias("banned")), "request_id", "left")
    hops = net.hops.drop("pattern_id")
    if goals is not None:
        at, hops = at.join(goal_bits(goals), "request_id"), hops.select("*", *[m.alias(f"mark_{i}") for i, m in enumerate(goal_marks())])
    ride = at.join(hops, ["day", "board_stop"]).filter("via_route <> route_id")
    if goals is not None:
        ride = ride.filter(" and ".join(f"shiftright(get(goal_bits, shiftright(mark_{i}, 6)), mark_{i} & 63) & 1 = 1" for i in range(GOAL_MARKS)))
    ride = ride.withColumn("cost", F.col("cost") + F.col("penalty") + F.col("seconds")).filter("best_total is null or cost < best_total")
    if banned is not None:
        ride = ride.filter(~F.coalesce(F.array_contains("banned", F.col("route_id")), F.lit(False)))
    if goals is not None:
        ride = ride.select("request_id", "stop_id", "cost", "pattern_no", "alight_idx", "board_idx", "board_stop", "route_id").join(goals, ["request_id", "stop_id"], "left_semi")
    best = ride.groupBy("request_id", "stop_id").agg(F.min(F.struct("cost", "pattern_no", "alight_idx", "board_idx", "board_stop", "route_id")).alias("a"))
    return best.select("request_id", "stop_id", "a.*")


def goal_marks() -> list[Column]:
    """Places of the bits that a stop sets."""
    return [F.pmod(F.shiftright(F.xxhash64("stop_id"), 16 * i), F.lit(64 * GOAL_WORDS)).cast("int") for i in range(GOAL_MARKS)]


def goal_bits(goals: DataFrame) -> DataFrame:
    """The bits (``goal_bits``) that the goals of a request set; a stop whose bits are not all there is no goal."""
    marks = goals.repartition("request_id").select("request_id", F.explode(F.array(*goal_marks())).alias("mark"))
    words = [F.expr(f"bit_or(CASE WHEN shiftright(mark, 6) = {i} THEN shiftleft(1L, mark & 63) ELSE 0L END)") for i in range(GOAL_WORDS)]
    return marks.groupBy("request_id").agg(F.array(*words).alias("goal_bits"))


def with_legs(rides: DataFrame, marked: DataFrame, net: Network) -> DataFrame:
    """Rides with the whole chain of legs that leads to them."""
    names = net.hops.select("pattern_no", "pattern_id").distinct()
    leg = F.struct("pattern_id", "route_id", "board_idx", "alight_idx", "board_stop", F.col("stop_id").alias("alight_stop"))
    before = marked.select("request_id", F.col("stop_id").alias("board_stop"), F.col("legs").alias("before"))
    return (rides.join(names, "pattern_no").join(before, ["request_id", "board_stop"])
            .select("request_id", "stop_id", "cost", F.col("route_id").alias("via_route"), F.concat("before", F.array(leg)).cast(LEG).alias("legs")))


def goal_stops(egress: DataFrame, requests: DataFrame, net: Network, rides: int) -> DataFrame:
    """Stops (``request_id``, ``stop_id``) from which, after a round, the last ``rides`` rounds can still change how a request ends.

    A ride that is walked from counts, as a walk may replace the ride that arrives where it leads.
    """
    here = lambda d: stage(d.unionByName(d.join(net.walks.select("stop_id", "from_id"), "stop_id").select("request_id", F.col("from_id").alias("stop_id"))).distinct())
    goals = here(egress.select("request_id", "stop_id").distinct())
    days = requests.select("request_id", "day")
    links = net.hops.select("day", "board_stop", "stop_id").distinct()
    for _ in range(rides):
        back = goals.join(days, "request_id").join(links, ["day", "stop_id"]).select("request_id", F.col("board_stop").alias("stop_id")).distinct()
        goals = here(goals.unionByName(back))
    return goals


def improving(arrivals: DataFrame, state: DataFrame, totals: DataFrame, order: list[str]) -> DataFrame:
    """Best arrival per request and stop that beats both what is known there and the best whole journey."""
    best = (arrivals.groupBy("request_id", "stop_id").agg(F.min(F.struct(*order, "via_route", "legs")).alias("a"))
            .select("request_id", "stop_id", "a.cost", "a.via_route", "a.legs"))
    return better(best, state, totals).select("request_id", "stop_id", "cost", "via_route", "legs")


def better(best: DataFrame, state: DataFrame, totals: DataFrame) -> DataFrame:
    return (best.join(state.select("request_id", "stop_id", F.col("cost").alias("known")), ["request_id", "stop_id"], "left")
            .join(totals.select("request_id", "best_total"), "request_id", "left")
            .filter("(known is null or cost < known) and (best_total is null or cost < best_total)").drop("known", "best_total"))


def walk_arrivals(rides: DataFrame, requests: DataFrame, net: Network) -> DataFrame:
    """One walk from a stop reached by a ride this round."""
    add = half_up(walk_seconds(F.col("meters")) * F.col("weight"))
    return (rides.withColumnRenamed("stop_id", "from_id").join(net.walks, "from_id")
            .join(requests.select("request_id", "weight"), "request_id")
            .select("request_id", "stop_id", (F.col("cost") + add).alias("cost"), "from_id", "via_route", "legs"))


def replaced(state: DataFrame, new: DataFrame) -> DataFrame:
    """``state`` with the rows of ``new``, which are strictly cheaper where both have one; only the keys of ``new`` are shuffled, not its legs."""
    every = new.unionByName(state.join(new.select("request_id", "stop_id"), ["request_id", "stop_id"], "left_anti"))
    return every.select("request_id", "stop_id", "cost", "via_route", "by_ride", "legs")


def round_step(state: DataFrame, marked: DataFrame, totals: DataFrame, requests: DataFrame, net: Network,
               banned: DataFrame | None = None, goals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One more ride (and one walk after it). Returns the new state and the stops improved in this round.

    With ``goals`` only the stops named there are looked at, and the new state has no other.
    """
    here, key = (lambda d: d if goals is None else d.join(goals, key, "left_semi")), ["request_id", "stop_id"]
    state = state if goals is None else stage(here(state))
    numbers = stage(better(best_rides(marked, requests, totals, net, banned, goals), state, totals))
    rides = stage(with_legs(numbers, marked, net).withColumn("by_ride", F.lit(True)))
    known = state.select(*key, "cost").unionByName(rides.select(*key, "cost")).groupBy(*key).agg(F.min("cost").alias("cost"))
    walks = stage(improving(here(walk_arrivals(rides, requests, net)), known, totals, ["cost", "from_id"]).withColumn("by_ride", F.lit(False)))
    new = stage(replaced(rides, walks))
    after = stage(replaced(state, new))
    drop(numbers, rides, walks, *([] if goals is None else [state]))
    return after, new


def finish(state: DataFrame, egress: DataFrame, requests: DataFrame, totals: DataFrame) -> DataFrame:
    """Best way to end each journey now, where it is clearly better than the plans before."""
    end = half_up(F.col("walk_s") * F.col("weight"))
    d = (state.filter("by_ride").join(egress.select("request_id", "stop_id", "walk_s"), ["request_id", "stop_id"])
         .join(requests.select("request_id", "weight"), "request_id"))
    best = (d.groupBy("request_id").agg(F.min(F.struct((F.col("cost") + end).alias("total"), "stop_id", "walk_s", "legs")).alias("b"))
            .select("request_id", "b.total", F.col("b.stop_id").alias("egress_stop"), F.col("b.walk_s").alias("egress_walk_s"), "b.legs"))
    return (best.join(totals, "request_id", "left")
            .filter(F.col("best_total").isNull() | ((F.col("total") + SAVING < F.col("best_total")) & (F.size("legs") > F.col("best_legs"))))
            .select("request_id", "total", "egress_stop", "egress_walk_s", "legs"))


def search(requests: DataFrame, access: DataFrame, egress: DataFrame, net: Network, banned: DataFrame | None = None,
           rounds: int | None = None) -> DataFrame:
    """Plans of each request, fewer rides first; each later plan is clearly cheaper.

    One more ride per round, until no stop improves or after ``rounds``. Costs only fall, so the search ends.
    """
    spark = requests.sparkSession
    state = marked = stage(start_state(requests, access))
    totals = spark.createDataFrame([], "request_id bigint, best_total bigint, best_legs int")
    plans = []
    for k in count(1):
        # The stops that are wanted get few only near the end; before that all are.
        goals = goal_stops(egress, requests, net, rounds - k) if rounds is not None and k >= rounds - 1 else None
        before, (state, marked) = (state, marked), round_step(state, marked, totals, requests, net, banned, goals)
        drop(*before[:1 + (k > 1)], *([] if goals is None else [goals]))  # at first both are one table
        found = stage(finish(state, egress, requests, totals))
        plans.append(found.withColumn("round", F.lit(k)))
        better = found.select("request_id", F.col("total").alias("best_total"), F.size("legs").alias("best_legs"))
        totals = stage(better.unionByName(totals.join(better, "request_id", "left_anti")))
        if k == rounds or marked.isEmpty():
            break
    start = access.groupBy("request_id", F.col("stop_id").alias("first_stop")).agg(F.min("walk_s").alias("access_walk_s"))
    d = reduce(DataFrame.unionByName, plans).withColumn("first_stop", F.get("legs", F.lit(0))["board_stop"])
    return stage(d.join(start, ["request_id", "first_stop"]).drop("first_stop"))


# ---- timetable resolution

def resolve(plans: DataFrame, requests: DataFrame, net: Network, positions: DataFrame) -> DataFrame:
    """One row per scheduled ride of every plan whose rides all find a trip in time."""
    at = positions.select("trip_id", F.col("idx").alias("alight_idx"), F.coalesce("arrival_s", "departure_s").alias("alight_s"))
    place = net.stops.select(F.col("stop_id"), "lat", "lon")
    key = ["request_id", "round", "leg"]
    todo = (plans.join(requests.select("request_id", "day", "depart_s"), "request_id")
            .withColumn("ready_s", F.col("depart_s") + F.col("access_walk_s")).withColumn("rides", F.size("legs")))
    done, longest = None, plans.agg(F.coalesce(F.max(F.size("legs")), F.lit(0))).first()[0]
    for i in range(max(longest, 1)):
        now = todo.filter(F.col("rides") > i).withColumn("leg", F.lit(i)).withColumn("l", F.get("legs", F.lit(i)))
        now = now.select("request_id", "round", "leg", "day", "ready_s", "rides", "legs", "l.*")
        run = tt.next_departure(now, key, net.departures, net.running)
        ride = (now.join(run, key).join(at, ["trip_id", "alight_idx"]).withColumn("alight_s", F.col("alight_s") + F.col("shift"))
                .filter("alight_s >= board_s").withColumn("wait_s", F.col("board_s") - F.col("ready_s")))
        ride = stage(ride)
        done = ride.drop("legs") if done is None else done.unionByName(ride.drop("legs"))
        if i + 1 < longest:
            nxt = ride.filter(F.col("rides") > i + 1).withColumn("next_stop", F.get("legs", F.lit(i + 1))["board_stop"])
            a = place.select(F.col("stop_id").alias("alight_stop"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
            b = place.select(F.col("stop_id").alias("next_stop"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
            gap = walk_seconds(haversine(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")))
            ready = F.col("alight_s") + F.when(F.col("alight_stop") == F.col("next_stop"), 0).otherwise(gap) + BUFFER
            todo = nxt.join(a, "alight_stop").join(b, "next_stop").select("request_id", "round", "day", ready.alias("ready_s"), "rides", "legs")
    whole = done.groupBy("request_id", "round").agg(F.count(F.lit(1)).alias("n"), F.max("rides").alias("r")).filter("n = r")
    return stage(done.join(whole.select("request_id", "round"), ["request_id", "round"], "left_semi"))


def same_route(rides: DataFrame) -> DataFrame:
    """Marks a ride that continues the previous one on the same route, and how far the rider walks to it."""
    w = W.partitionBy("request_id", "round").orderBy("leg")
    return (rides.withColumn("prev_route", F.lag("route_id").over(w)).withColumn("prev_stop", F.lag("alight_stop").over(w))
            .withColumn("continues", F.coalesce((F.col("prev_route") == F.col("route_id")) & (F.col("prev_stop") == F.col("board_stop")), F.lit(False)))
            .withColumn("transfer", F.coalesce(F.col("prev_route") != F.col("route_id"), F.lit(False))))


def change_walks(rides: DataFrame, stops: DataFrame) -> DataFrame:
    a = stops.select(F.col("stop_id").alias("prev_stop"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    b = stops.select(F.col("stop_id").alias("board_stop"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    gap = haversine(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    moved = F.coalesce(F.col("prev_stop") != F.col("board_stop"), F.lit(False))
    return (same_route(rides).join(a, "prev_stop", "left").join(b, "board_stop", "left")
            .withColumn("change_m", F.when(moved, half_up(gap * 1.3)).otherwise(0))
            .withColumn("change_s", F.when(moved, walk_seconds(gap)).otherwise(0)).drop("alat", "alon", "blat", "blon"))


def journeys(rides: DataFrame, plans: DataFrame, requests: DataFrame, net: Network) -> DataFrame:
    """Totals of each scheduled plan."""
    d = change_walks(rides, net.stops)
    new = ~F.col("continues")
    chain = F.struct("leg", F.concat(F.col("route_id").cast("string"), F.lit("@"), F.col("board_stop").cast("string")).alias("b"),
                     F.col("alight_stop").cast("string").alias("e"), F.col("continues").alias("c"))
    per = d.groupBy("request_id", "round").agg(
        F.count(F.when(F.col("transfer"), 1)).alias("transfers"), F.count(F.when(new, 1)).alias("bus_legs"),
        F.sum(F.col("alight_s") - F.col("board_s")).alias("ride_s"), F.sum("wait_s").alias("wait_s"),
        F.sum(F.col("alight_idx") - F.col("board_idx")).alias("hops"), F.sum("change_s").alias("change_s"), F.sum("change_m").alias("change_m"),
        F.max_by("alight_s", "leg").alias("last_s"), F.min_by("board_stop", "leg").alias("first_stop"), F.max_by("alight_stop", "leg").alias("last_stop"),
        F.min_by("route_id", "leg").alias("first_route"), F.array_sort(F.collect_list(chain)).alias("chain"))
    at = lambda n, p: net.stops.select(F.col("stop_id").alias(n), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"))
    # route@board>exit; per ride, where a continued ride keeps its first boarding and its last exit.
    key = F.aggregate("chain", F.lit(""), lambda acc, x: F.when(x["c"], F.concat(F.regexp_replace(acc, ">[^>]*$", ">"), x["e"], F.lit(";")))
                      .otherwise(F.concat(acc, x["b"], F.lit(">"), x["e"], F.lit(";"))))
    out = (per.withColumn("ride_key", key).join(plans.select("request_id", "round", "access_walk_s", "egress_walk_s"), ["request_id", "round"])
           .join(requests.select("request_id", "depart_s", "from_lat", "from_lon", "to_lat", "to_lon"), "request_id")
           .join(at("first_stop", "f"), "first_stop").join(at("last_stop", "t"), "last_stop"))
    walk_m = (half_up(haversine(F.col("from_lat"), F.col("from_lon"), F.col("flat"), F.col("flon")) * 1.3)
              + half_up(haversine(F.col("tlat"), F.col("tlon"), F.col("to_lat"), F.col("to_lon")) * 1.3))
    arrive = F.col("last_s") + F.col("egress_walk_s")
    return out.select("request_id", "round", "transfers", "bus_legs", "ride_s", "wait_s", "hops", "first_route", "ride_key",
                      (F.col("access_walk_s") + F.col("egress_walk_s") + F.col("change_s")).alias("walking_s"),
                      (walk_m + F.col("change_m")).alias("walking_m"), arrive.alias("arrive_s"),
                      F.greatest(F.lit(0), arrive - F.col("depart_s")).alias("duration_s"))


def alternatives(requests: DataFrame, access: DataFrame, egress: DataFrame, net: Network, positions: DataFrame,
                 attempts: int | None = None, rounds: int | None = None, keep: int | None = None):
    """Repeated searches per request; each bans the first route of the best schedulable plan before it.

    Ends when no request has a plan left, or after ``attempts``.

    Returns (journeys in presentation order, requests that had any plan).
    """
    banned = requests.sparkSession.createDataFrame([], "request_id bigint, route_id bigint")
    open_requests, found, planned = requests, [], []
    for attempt in count():
        plans = search(open_requests, access, egress, net, banned if attempt else None, rounds)
        rides = resolve(plans, requests, net, positions)
        built = stage(journeys(rides, plans, requests, net).withColumn("attempt", F.lit(attempt)))
        found.append(built)
        planned.append(plans.select("request_id").distinct())
        ok = built.groupBy("request_id").agg(F.min_by("first_route", "round").alias("scheduled"))
        any_plan = plans.groupBy("request_id").agg(F.min_by(F.get("legs", F.lit(0))["route_id"], "round").alias("planned"))
        ban = any_plan.join(ok, "request_id", "left").select("request_id", F.coalesce("scheduled", "planned").alias("route_id"))
        banned = stage(banned.unionByName(ban))
        open_requests = stage(open_requests.join(ban, "request_id", "left_semi"))
        if attempt + 1 == attempts or open_requests.isEmpty():
            break
    every = reduce(DataFrame.unionByName, found)
    first = every.groupBy("request_id", "ride_key").agg(F.min(F.struct("attempt", "round")).alias("k"))
    kept = every.join(first.select("request_id", "ride_key", "k.attempt", "k.round"), ["request_id", "ride_key", "attempt", "round"])
    order = W.partitionBy("request_id").orderBy("arrive_s", "transfers", "walking_s", "attempt", "round")
    ranked = first_ranks(kept.withColumn("place", F.row_number().over(order)), keep, "place")
    return ranked, reduce(DataFrame.unionByName, planned).distinct()


def reasons_for(requests: DataFrame, access: DataFrame, egress: DataFrame, planned: DataFrame, built: DataFrame) -> DataFrame:
    """Why a request has no journey, or NONE."""
    mark = lambda d, n: d.select("request_id").distinct().withColumn(n, F.lit(True))
    d = requests.select("request_id")
    for t, n in ((access, "a"), (egress, "e"), (planned, "p"), (built, "b")):
        d = d.join(mark(t, n), "request_id", "left")
    return d.select("request_id", F.when(F.col("a").isNull(), "NO_STOP_NEAR_START").when(F.col("e").isNull(), "NO_STOP_NEAR_DESTINATION")
                    .when(F.col("b").isNotNull(), "NONE").when(F.col("p").isNotNull(), "NO_SERVICE").otherwise("NO_JOURNEY").alias("reason"))


def segments(rides: DataFrame, plans: DataFrame, stops: DataFrame) -> DataFrame:
    """WALK / BUS / TRANSFER rows of each journey in order; a continued ride stays one BUS segment."""
    d = change_walks(rides, stops)
    w = W.partitionBy("request_id", "round").orderBy("leg").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("part", F.sum(F.when(F.col("continues"), 0).otherwise(1)).over(w))
    bus = d.groupBy("request_id", "round", "part").agg(
        F.min_by("route_id", "leg").alias("route_id"), F.min_by("board_stop", "leg").alias("from_stop"), F.max_by("alight_stop", "leg").alias("to_stop"),
        (F.max("alight_s") - F.min("board_s")).alias("seconds"))
    bus = bus.select("request_id", "round", (F.col("part") * 2).alias("ord"), F.lit("BUS").alias("kind"), "route_id", "from_stop", "to_stop", "seconds")
    moved = d.filter("part > 1 and not continues and (transfer or change_m > 0)")
    change = moved.select("request_id", "round", (F.col("part") * 2 - 1).alias("ord"), F.when(F.col("transfer"), "TRANSFER").otherwise("WALK").alias("kind"),
                          F.lit(None).cast("bigint").alias("route_id"), F.col("prev_stop").alias("from_stop"), F.col("board_stop").alias("to_stop"),
                          F.col("change_s").alias("seconds"))
    ends = rides.groupBy("request_id", "round").agg(F.min_by("board_stop", "leg").alias("f"), F.max_by("alight_stop", "leg").alias("t"))
    ends = ends.join(plans.select("request_id", "round", "access_walk_s", "egress_walk_s"), ["request_id", "round"])
    none = F.lit(None).cast("bigint")
    first = ends.select("request_id", "round", F.lit(0).alias("ord"), F.lit("WALK").alias("kind"), none.alias("route_id"), none.alias("from_stop"),
                        F.col("f").alias("to_stop"), F.col("access_walk_s").alias("seconds"))
    last = ends.select("request_id", "round", F.lit(1000).alias("ord"), F.lit("WALK").alias("kind"), none.alias("route_id"), F.col("t").alias("from_stop"),
                       none.alias("to_stop"), F.col("egress_walk_s").alias("seconds"))
    every = reduce(DataFrame.unionByName, [first, bus, change, last])
    return every.withColumn("ord", F.row_number().over(W.partitionBy("request_id", "round").orderBy("ord")))


def stop_list(rides: DataFrame, positions: DataFrame) -> DataFrame:
    """Stops of each journey in order with their role; a stop where the rider changes bus is listed once."""
    w = W.partitionBy("request_id", "round").orderBy("leg")
    r = same_route(rides).withColumn("next_route", F.lead("route_id").over(w))
    p = positions.select("trip_id", "idx", "stop_id")
    d = (r.join(p, "trip_id").filter("idx between board_idx and alight_idx")
         .filter(~((F.col("idx") == F.col("board_idx")) & F.coalesce(F.col("prev_stop") == F.col("stop_id"), F.lit(False)))))
    o = W.partitionBy("request_id", "round").orderBy("leg", "idx")
    back = W.partitionBy("request_id", "round").orderBy(F.desc("leg"), F.desc("idx"))
    d = d.withColumn("place", F.row_number().over(o)).withColumn("left", F.row_number().over(back))
    changes_next = (F.col("idx") == F.col("alight_idx")) & F.coalesce(F.col("next_route") != F.col("route_id"), F.lit(False))
    changes_here = (F.col("idx") == F.col("board_idx")) & F.col("transfer")
    role = (F.when(F.col("place") == 1, "BOARDING").when(F.col("left") == 1, "EXIT").when(changes_next | changes_here, "TRANSFER")
            .otherwise("INTERMEDIATE"))
    return d.select("request_id", "round", "place", "stop_id", role.alias("role"))


def headsigns(rides: DataFrame, trips: DataFrame, layer, stops: DataFrame) -> DataFrame:
    """Destination sign and direction of each ride: the trip's own, else the pattern's last stop and direction."""
    last = layer.stops.groupBy("pattern_id").agg(F.max_by("stop_id", "idx").alias("stop_id"))
    end = last.join(stops.select("stop_id", "stop_name"), "stop_id").select("pattern_id", "stop_name")
    own = trips.select("trip_id", "headsign", "direction_id")
    p = layer.patterns.select("pattern_id", F.col("direction_id").alias("pattern_direction"))
    return (rides.join(own, "trip_id").join(end, "pattern_id").join(p, "pattern_id")
            .select("request_id", "round", "leg", F.coalesce("headsign", "stop_name").alias("headsign"),
                    F.when(F.col("headsign").isNotNull(), "TRIP").otherwise("TERMINAL_STOP").alias("headsign_source"),
                    F.coalesce("direction_id", "pattern_direction").alias("direction_id")))
