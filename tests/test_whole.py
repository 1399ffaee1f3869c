"""Nothing is cut unless a caller asks for it, and feeds without optional tables keep their rows."""

import json

from pyspark.sql import functions as F

from wayline.functions import text as tx
from wayline.operators import constraints as c
from wayline.operators.nearby import nearest, window_stops
from wayline.plans import areas, bus_feed, saved
from wayline.sources import provider


def test_all_routes_and_steps(spark):
    step = {"travelMode": "WALK", "distanceMeters": 5, "staticDuration": "1s"}
    route = {"duration": "9s", "polyline": {"encodedPolyline": "a"}, "warnings": ["w" * 300] * 7, "legs": [{"steps": [step] * 1200}, {"steps": [step] * 3}]}
    df = spark.createDataFrame([(1, json.dumps({"routes": [route] * 8}))], "response_id bigint, raw string")
    routes = provider.routes(df)
    assert [(r.idx, r.warnings) for r in routes.orderBy("idx").collect()] == [(i, 7) for i in range(8)]
    steps = provider.steps(routes)
    assert steps.count() == 8 * 1203
    assert steps.select("idx", "seq").distinct().count() == 8 * 1203


def test_all_stops(spark):
    stops = spark.range(90).select(F.col("id").alias("stop_id"), F.concat(F.lit("s"), "id").alias("stop_name"), (28 + F.col("id") / 10_000).alias("lat"), F.lit(77.0).alias("lon"))
    points = spark.createDataFrame([(1, 28.0, 77.0)], "request_id bigint, plat double, plon double")
    assert nearest(points, "request_id", stops, 5000).count() == 90
    assert [r.stop_id for r in nearest(points, "request_id", stops, 5000, 3).orderBy("rank").collect()] == [0, 1, 2]
    window = spark.createDataFrame([(1, 27.99, 28.02, 76.99, 77.01)], "window_id bigint, south double, north double, west double, east double")
    assert window_stops(window, stops).count() == 90


def test_long_names_and_recent(spark):
    row = spark.range(1).select(tx.display(F.lit("n" * 1000)).alias("d"), tx.clean_label(F.lit("l" * 500)).alias("l"),
                                tx.clean_label(F.lit("l" * 500), 40).alias("short"), tx.is_place_id(F.lit("p" * 900)).alias("p")).first()
    assert (len(row.d), len(row.l), row.short, row.p) == (1000, 500, None, True)
    seen = spark.range(30).select(F.lit(1).alias("user_id"), F.col("id").alias("journey_key"), F.lit("2024-01-02").cast("timestamp").alias("ts"), F.col("id").alias("event_id"))
    now = F.lit("2024-01-03").cast("timestamp")
    assert (saved.recent(seen, now).count(), saved.recent(seen, now, 10).count()) == (30, 10)


def test_long_parent_chain_is_no_loop(spark):
    claims = spark.range(150).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    claims = claims.unionByName(spark.createDataFrame([(500, 501), (501, 500), (502, 500)], "child bigint, parent bigint"))
    stored = spark.range(600).select(F.col("id").alias("area_id"))
    got = {r.child: r.outcome for r in areas.parent_links(claims, stored).collect()}
    assert {got[i] for i in range(150)} == {"linked"} and {got[i] for i in (500, 501, 502)} == {"ambiguous"}


def test_feed_without_agency_or_calendar(spark):
    text = lambda cols, *rows: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"{x} string" for x in cols.split()) + ", row_pos bigint")
    ids = lambda name: spark.createDataFrame([], f"{name} string")
    route = text("route_id agency_id route_short_name route_long_name route_type route_color", ("R1", "A9", "1", "One", "3", ""))
    judged = lambda check: bus_feed.routes(route, ids("agency_id"), check).select("outcome").first()[0]
    assert (judged(True), judged(False)) == ("rejected", "accepted")


def test_constraints(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 1, 4), ("a", 3, 9), ("b", 0, 1), ("b", 0, 2)], "k string, i bigint, v bigint")
    parents = spark.createDataFrame([("a",), ("c",)], "k string")
    assert {r.k for r in c.gaps(rows, "k", "i").collect()} == {"a", "b"}
    assert [r.v for r in c.falling(rows.filter("k = 'a'"), "k", "i", "v").collect()] == [4]
    assert c.dangling(rows, parents, "k").count() == 2
    assert [r.k for r in c.child_count(parents, rows, "k", F.col("children") > 0).collect()] == ["c"]
    assert [r.k for r in c.not_unique(rows, "k", "i").collect()] == ["b"]
