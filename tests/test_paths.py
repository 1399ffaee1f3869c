"""Paths of rides and boardings of patterns against brute force, and that equal rides are looked at once."""

import random
from types import SimpleNamespace

import pytest

from wayline.catalog import metro_journeys as cat
from wayline.plans import bus_plan as b, metro as m, metro_journey as mj

RIDE = "ride_id string, board string, exit string, hops bigint"


def graph(rng, n=9, more=5):
    edges = {(f"R{i % 3}", f"s{i}", f"s{i + 1}") for i in range(n - 1)}
    return sorted(edges | {(f"R{rng.randint(0, 2)}", f"s{x}", f"s{y}") for x, y in (sorted(rng.sample(range(n), 2)) for _ in range(more))})


def simple(edges, board, exit_, hops):
    near, found = {}, []
    for _, x, y in edges:
        near.setdefault(x, set()).add(y), near.setdefault(y, set()).add(x)

    def grow(path):
        if len(path) == hops + 1:
            found.extend([path] if path[-1] == exit_ else [])
        else:
            [grow([*path, y]) for y in near.get(path[-1], ()) if y not in path]

    grow([board])
    return found


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)

    def call(*a):
        calls.append(real(*a))
        return calls[-1]

    monkeypatch.setattr(module, name, call)
    return calls


def test_rides_are_rebuilt_and_equal_ones_ask_once(spark, monkeypatch):
    rng = random.Random(5)
    edges = graph(rng)
    conn = spark.createDataFrame(edges, "route_id string, from_station string, to_station string")
    ends = [(f"s{rng.randint(0, 8)}", f"s{rng.randint(0, 8)}", rng.randint(1, 5)) for _ in range(40)] + [("s1", None, 0), (None, "s2", 2), ("s1", "s0", 1)]
    rides = [(f"t{i}", *e) for i, e in enumerate(ends)]
    want = {r: p[0] for r, a, z, h in rides if len(p := [[a]] if h == 0 else simple(edges, a, z, h)) == 1}
    assert len(want) > 5

    def run(some):
        staged = counted(monkeypatch, m, "stage")
        paths = m.reconstruct(spark.createDataFrame(some, RIDE), conn)
        got = {r.ride_id: r.path for r in paths.collect()}
        monkeypatch.undo()
        return paths, got, sum(x.count() for x in staged)

    paths, got, few = run(rides)
    assert got == want
    _, got, many = run([(f"{r}/{k}", *e) for r, *e in rides for k in range(4)])
    assert got == {f"{r}/{k}": p for r, p in want.items() for k in range(4)} and many == few
    twice = run([rides[-1], rides[-1]])[1]
    assert twice == {}  # an id that comes twice has no one path
    of = {}
    for r, x, y in edges:
        of.setdefault(frozenset((x, y)), set()).add(r)
    served = {(r, s) for r, p in want.items() if len(p) > 1 for s in set.intersection(*(of[frozenset(e)] for e in zip(p, p[1:])))}
    assert sorted(tuple(r) for r in m.services_on_path(paths, conn).collect()) == sorted(served) and served


@pytest.mark.parametrize("seed", [1, 2])
def test_line_paths_are_the_only_simple_ones(spark, seed):
    rng = random.Random(seed)
    edges = graph(rng, 8, 4)
    cand = [("L", "R0"), ("L", "R1"), ("M", None)]
    asks = {(i, rng.choice("LM"), f"s{rng.randint(0, 7)}", f"s{rng.randint(0, 7)}", rng.randint(1, 6)) for i in range(60)}
    want = {}
    for i, line, a, z, h in asks:
        paths = simple([e for e in edges if line == "M" or ("L", e[0]) in cand], a, z, h) if a != z else []
        if len(paths) == 1:
            want[i] = paths[0]
    got = mj.ride_paths(spark.createDataFrame(sorted(asks), "request bigint, line string, board string, exit string, hops int"),
                        spark.createDataFrame(cand, "line string, service string"), spark.createDataFrame(edges, "service string, a string, b string"))
    assert {r.request: r.path for r in got.collect()} == want and len(want) > 5


def test_one_walk_needs_no_rounds_of_its_own(spark, monkeypatch):
    edges = [("R", f"s{i}", f"s{i + 1}") for i in range(6)]
    staged = counted(monkeypatch, mj, "stage")
    got = mj.ride_paths(spark.createDataFrame([(1, "L", "s0", "s6", 6), (2, "L", "s6", "s1", 5)], "request bigint, line string, board string, exit string, hops int"),
                        spark.createDataFrame([("L", "R")], "line string, service string"), spark.createDataFrame(edges, "service string, a string, b string"))
    assert {r.request: len(r.path) for r in got.collect()} == {1: 7, 2: 6}
    assert len(staged) <= 6 + 10


def test_paths_of_a_query_are_looked_for_once(spark, monkeypatch):
    station = spark.createDataFrame([(f"s{i}", f"Stop {i}", 20 + i / 100, 70.0) for i in range(4)], "station string, name string, lat double, lon double")
    service = spark.createDataFrame([("A", "G", "Line 1", "Line 1")], "service string, group_id string, group_name string, name string")
    edges = spark.createDataFrame([("A", f"s{i}", f"s{i + 1}") for i in range(3)], "service string, a string, b string")
    steps = [(1, 0, "RIDE", 9, 9, 3, "Line 1", "SUBWAY", "Stop 0", 20.0, 70.0, "Stop 3", 20.03, 70.0), (2, 0, "RIDE", 9, 9, 2, "Line 1", "SUBWAY", "Stop 0", 20.0, 70.0, "Stop 3", 20.03, 70.0)]
    t = SimpleNamespace(n_station=station, n_service=service, n_step=edges, n_provider_step=spark.createDataFrame(
        steps, "route_id bigint, seq bigint, kind string, meters bigint, seconds bigint, stop_count bigint, line string, vehicle string, from_name string, from_lat double, from_lon double, to_name string, to_lat double, to_lon double"))
    found, matched = counted(monkeypatch, mj, "ride_paths"), counted(monkeypatch, mj, "match_stops")
    assert [tuple(r) for r in cat.gr5(t).collect()] == [("Line 1", "s0", "s3", 3, "s0|s1|s2|s3")] and (len(found), len(matched)) == (1, 1)
    assert [tuple(r) for r in cat.gr6(t).collect()] == [("Line 1", "s0", "s3", 3, "A")] and (len(found), len(matched)) == (2, 2)


def test_arrivals_by_every_boarded_pattern(spark):
    rng = random.Random(3)
    calls = [(f"p{p}", p % 4, i, s, 60 * i, 30 * (p % 5)) for p in range(12) for i, s in enumerate(rng.sample(range(10), 5))]
    active = sorted({(d, f"p{p}") for p in range(12) for d in ("mon", "tue") if rng.random() < 0.7})
    net = b.Network(None, None, None, None, None, None, None)
    net.__dict__.update(calls=spark.createDataFrame(calls, "pattern_id string, route_id bigint, idx bigint, stop_id bigint, offset_s bigint, wait_s bigint"), active=spark.createDataFrame(active, "day string, pattern_id string"))
    asks = spark.createDataFrame([(i, "mon" if i % 2 else "tue", 180) for i in range(6)], "request_id bigint, day string, penalty int")
    marked = [(i, s, 60 * rng.randint(0, 4), rng.choice([-1, 0, 1]), False, []) for i in range(6) for s in rng.sample(range(10), 4)]
    want = []
    for i in range(6):
        for p in {c[0] for c in calls}:
            line = [c for c in calls if c[0] == p]
            cost = {s: (c, via) for r, s, c, via, *_ in marked if r == i}
            on = [(cost[c[3]][0] + c[5] + 180 - c[4], c[2]) for c in line if c[3] in cost and cost[c[3]][1] != c[1] and ("mon" if i % 2 else "tue", p) in active]
            want += [(i, p, c[2], min(x for x in on if x[1] < c[2])[0] + c[4], min(x for x in on if x[1] < c[2])[1]) for c in line if any(x[1] < c[2] for x in on)]
    boards = b.boardings(spark.createDataFrame(marked, f"request_id bigint, stop_id bigint, cost bigint, via_route bigint, by_ride boolean, legs {b.LEG}"), asks, net, None)
    got = b.ride_arrivals(boards, net)
    assert sorted((r.request_id, r.pattern_id, r.idx, r.cost, r.legs[0].board_idx) for r in got.collect()) == sorted(want) and len(want) > 40
    # The rows per later position are made after the last shuffle.
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_positions_that_come_twice_keep_a_row_per_copy(spark):
    net = b.Network(None, None, None, None, None, None, None)
    calls = [("p", 7, i, 10 + i, 60 * i, 0) for i in range(3)]
    net.__dict__.update(calls=spark.createDataFrame(calls * 2, "pattern_id string, route_id bigint, idx bigint, stop_id bigint, offset_s bigint, wait_s bigint"), active=spark.createDataFrame([("mon", "p")], "day string, pattern_id string"))
    marked = spark.createDataFrame([(1, 10, 50, -1, False, []), (1, 11, 0, -1, False, [])], f"request_id bigint, stop_id bigint, cost bigint, via_route bigint, by_ride boolean, legs {b.LEG}")
    asks = spark.createDataFrame([(1, "mon", 180)], "request_id bigint, day string, penalty int")
    got = b.ride_arrivals(b.boardings(marked, asks, net, None), net).collect()
    # Two copies of the line times two boardings at each of the first two positions: the first row there sees only the positions before.
    want = [(0, 230, 0)] * 3 + [(1, 290, 0)] + [(1, 180, 1)] * 3 + [(2, 240, 1)] * 2
    assert sorted((r.legs[0].alight_idx, r.cost, r.legs[0].board_idx) for r in got) == sorted(want)
