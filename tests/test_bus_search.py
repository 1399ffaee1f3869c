"""Search rounds over rides per stop pair against the rides of every boarded pattern."""

import random

from wayline.plans import bus_plan as b

STATE = f"request_id bigint, stop_id bigint, cost bigint, via_route bigint, by_ride boolean, legs {b.LEG}"


def network(spark, rng):
    net = b.Network(None, None, None, None, None, None, None)
    calls, active = [], []
    for p in range(30):
        stops = rng.sample(range(14), rng.randint(2, 6))
        calls += [(f"p{p * 7 % 30:02d}", p % 6, i, s, 60 * i + rng.choice([0, 0, 30]), 120) for i, s in enumerate(stops)]
        active += [(d, f"p{p * 7 % 30:02d}") for d in ("mon", "tue") if rng.random() < 0.8]
    walks = [(x, y, 100.0) for x, y in ((1, 2), (2, 1), (5, 9), (9, 5), (3, 12), (12, 3))]
    net.__dict__.update(calls=spark.createDataFrame(calls, "pattern_id string, route_id bigint, idx bigint, stop_id bigint, offset_s bigint, wait_s bigint"),
                        active=spark.createDataFrame(active, "day string, pattern_id string"), walks=spark.createDataFrame(walks, "from_id bigint, stop_id bigint, meters double"))
    return net


def requests(spark):
    return spark.createDataFrame([(i, "mon" if i % 2 else "tue", 180, 1.5) for i in range(8)], "request_id bigint, day string, penalty int, weight double")


def rows(df, *cols):
    return sorted(map(repr, df.select(*cols).collect()))


def test_rides_per_stop_pair_are_the_least_arrivals(spark):
    rng = random.Random(7)
    net, asks = network(spark, rng), requests(spark)
    marked = spark.createDataFrame([(i, s, 60 * rng.randint(0, 4), rng.choice([-1, 0, 1, 2]), False, []) for i in range(8) for s in rng.sample(range(14), 4)], STATE)
    totals = spark.createDataFrame([(1, 500, 1), (2, 400, 1)], "request_id bigint, best_total bigint, best_legs int")
    for banned in (None, spark.createDataFrame([(i, r) for i in range(6) for r in (i % 6, 5)], "request_id bigint, route_id bigint")):
        want = b.improving(b.ride_arrivals(b.boardings(marked, asks, net, banned), net), marked, totals, ["cost", "pattern_id", "idx"])
        got = b.with_legs(b.better(b.best_rides(marked, asks, totals, net, banned, None), marked, totals), marked, net)
        cols = ["request_id", "stop_id", "cost", "via_route", "legs"]
        assert rows(got, *cols) == rows(want, *cols) and got.count() > 20


def test_goal_stops_change_no_plan(spark, monkeypatch):
    rng = random.Random(11)
    net, asks = network(spark, rng), requests(spark)
    ends = [spark.createDataFrame([(i, s, 30 * (s % 4)) for i in range(8) for s in rng.sample(range(14), 2)], "request_id bigint, stop_id bigint, walk_s bigint") for _ in range(2)]
    cols = ["request_id", "round", "total", "egress_stop", "egress_walk_s", "access_walk_s", "legs"]
    got = rows(b.search(asks, *ends, net, rounds=2), *cols)
    monkeypatch.setattr(b, "goal_stops", lambda *a: None)
    assert got == rows(b.search(asks, *ends, net, rounds=2), *cols) and got


def test_rides_that_lead_to_no_goal_are_not_shuffled(spark):
    rng = random.Random(5)
    net, asks = network(spark, rng), requests(spark)
    marked = spark.createDataFrame([(i, s, 60 * rng.randint(0, 4), -1, False, []) for i in range(8) for s in rng.sample(range(14), 6)], STATE)
    totals = spark.createDataFrame([], "request_id bigint, best_total bigint, best_legs int")
    goals = spark.createDataFrame([(i, s) for i in range(7) for s in rng.sample(range(14), 2)], "request_id bigint, stop_id bigint")
    every, asked = (b.best_rides(marked, asks, totals, net, None, g) for g in (None, goals))
    cols = ["request_id", "stop_id", "cost", "pattern_no", "alight_idx", "board_idx", "board_stop", "route_id"]
    assert rows(asked, *cols) == rows(every.join(goals, ["request_id", "stop_id"], "left_semi"), *cols) and asked.count() > 3
    assert "goal_bits" in asked._jdf.queryExecution().optimizedPlan().toString()


def test_a_round_shuffles_no_legs_of_its_new_rows_and_keeps_goals_only(spark):
    rng = random.Random(3)
    net, asks = network(spark, rng), requests(spark)
    first = spark.createDataFrame([(i, s, 600 * rng.randint(0, 4), -1, False, []) for i in range(8) for s in rng.sample(range(14), 3)], STATE)
    none = spark.createDataFrame([], "request_id bigint, best_total bigint, best_legs int")
    state, new = b.round_step(first, first, none, asks, net)
    best = {}
    for r in [*first.collect(), *new.collect()]:
        k = (r.request_id, r.stop_id)
        best[k] = min([best[k], r] if k in best else [r], key=lambda x: x.cost)
    assert rows(state, *first.columns) == sorted(map(repr, best.values()))
    goals = spark.createDataFrame([(i, s) for i in range(8) for s in (1, 2, 3)], "request_id bigint, stop_id bigint")
    some, few = b.round_step(state, new, none, asks, net, None, goals)
    every, _ = b.round_step(state, new, none, asks, net)
    assert {r.stop_id for r in some.collect()} <= {1, 2, 3} and {r.stop_id for r in few.collect()} <= {1, 2, 3}
    assert rows(some, "request_id", "stop_id", "cost") == rows(every.filter("stop_id in (1, 2, 3)"), "request_id", "stop_id", "cost")
