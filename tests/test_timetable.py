"""Next departures against a plain search."""

import datetime
import random

from wayline.plans import timetable as tt


def test_next_departure_asks_only_the_calls_it_meets(spark):
    rng, day = random.Random(2), datetime.date(2026, 3, 2)
    days = [day + datetime.timedelta(d) for d in range(-1, 3)]
    running = [(d, s) for d in days for s in ("A", "B", "C") if rng.random() < 0.6]
    calls = [(t, rng.randint(0, 2), rng.randint(0, 2 * tt.DAY - 1), rng.choice("PQ"), rng.choice("ABCD")) for t in range(400)]
    calls += [(1000, 0, tt.DAY + 600, "P", s) for s in "ABC"] + [(1001, 0, 600, "P", s) for s in "ABC"]
    wanted = [(i, rng.choice(days[1:]), rng.randint(0, tt.DAY - 1), rng.choice("PQ"), rng.randint(0, 2)) for i in range(60)] + [(60, day, 600, "P", 0), (61, day, tt.DAY - 60, "Q", 1)]
    w = spark.createDataFrame(wanted, "request_id int, day date, ready_s int, pattern_id string, board_idx int")
    c = spark.createDataFrame(calls, "trip_id int, board_idx int, board_s int, pattern_id string, service_id string")
    got = tt.next_departure(w, ["request_id"], c, spark.createDataFrame(running, "day date, service_id string"))
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()  # no copies of the calls
    want = {}
    for i, d, ready, p, at in wanted:
        found = [(s + shift, trip, shift) for trip, idx, s, pattern, service in calls if (pattern, idx) == (p, at)
                 for shift, on in ((0, d), (-tt.DAY, d - datetime.timedelta(1))) if (on, service) in running and 0 <= s + shift - ready <= tt.MAX_WAIT]
        if found:
            want[i] = min(found)
    assert {r.request_id: (r.board_s, r.trip_id, r["shift"]) for r in got.collect()} == want and len(want) > 20
