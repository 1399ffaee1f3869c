"""Order of routes by preference and the timeline of their areas, against plain loops."""

import random

from wayline.operators.ordered import WIDTH
from wayline.plans import compare as c


def test_ranks_are_taken_where_routes_are_ordered(spark):
    rng, rows = random.Random(5), []
    for session in range(40):
        for k in range(rng.randint(1, 7)):
            values = [rng.randint(1, 3) * (WIDTH if rng.random() < 0.2 else 1), rng.choice([None, 10, 20]), rng.randint(0, 2), rng.randint(0, 900)]
            rows.append((session, session * 10 + k, k, rng.choice([None, 0, 2]), rng.random() < 0.8, *values))
    names = list(c.CRITERIA.values())
    remaining = spark.createDataFrame(rows, "session_id bigint, route_id bigint, idx int, tier int, kept boolean, " + ", ".join(f"{n} bigint" for n in names))
    used = {s: [n for n in c.CRITERIA if rng.random() < 0.6] for s in range(30)}
    statuses = spark.createDataFrame([(s, n, "applied") for s, u in used.items() for n in u] + [(35, "fastest", "no-difference")], "session_id bigint, criterion string, status string")
    got = c.preferred_order(remaining, statuses)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(session_id") <= 2  # the criteria and the routes
    below = lambda v: -1 if v is None else v
    want = {}
    for s in range(40):
        mine = [r for r in rows if r[0] == s and r[4]]
        for r in mine:
            ranks = [1 + sum(below(o[5 + i]) < below(r[5 + i]) for o in mine) if r[5 + i] is not None else None for i, n in enumerate(c.CRITERIA) if n in used.get(s, [])]
            want[r[1]] = (r[3] or 0, None if None in ranks else sum(ranks), r[2])
    found = {r.route_id: (r.tier, r.total, r.place) for r in got.collect()}
    assert {k: v[:2] for k, v in found.items()} == {k: v[:2] for k, v in want.items()}
    for s in range(40):
        mine = sorted((r[1] for r in rows if r[0] == s and r[4]), key=lambda x: (want[x][0], below(want[x][1]), want[x][2]))
        assert [found[x][2] for x in mine] == [*range(1, len(mine) + 1)]


def test_timeline_marks_what_was_matched_and_chosen(spark):
    areas = spark.createDataFrame([(1, 10, 7, 1, -0.5), (1, 10, 8, 2, 0.5), (1, 10, None, 3, 2.0), (2, 20, 7, 1, 0.1), (None, None, 7, 1, 0.2)],
                                  "session_id bigint, route_id bigint, area_id bigint, sequence int, position double")
    matched = spark.createDataFrame([(10, 8), (10, 8), (10, None), (20, 9), (None, 7)], "route_id bigint, area_id bigint")
    selected = spark.createDataFrame([(1, 7), (1, None), (2, 8), (None, 7)], "session_id bigint, area_id bigint")
    got = sorted(((r.route_id or 0, r.place, r.position, r.matched, r.selected) for r in c.timeline(areas, matched, selected).collect()))
    assert got == [(0, 1, 0.2, False, False), (10, 1, 0.0, False, True), (10, 2, 0.5, True, False), (10, 3, 1.0, False, False), (20, 1, 0.1, False, False)]
