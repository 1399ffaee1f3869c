"""Sides that only look small are shuffled, so the driver never gathers them."""

from wayline.plans import metro_journey as mj, shapes as sh


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stops_and_stations_meet_without_a_broadcast(spark):
    stops = spark.createDataFrame([("Halt North", 20.0, 70.0), ("Halt", None, None)], "name string, lat double, lon double")
    stations = spark.createDataFrame([("S1", "Halt North", 20.0, 70.0)], "station string, name string, lat double, lon double")
    d = mj.match_stops(stops, stations)
    assert "Broadcast" not in plan(d)
    assert {(r.name, r.station) for r in d.collect()} == {("Halt North", "S1"), ("Halt", "S1")}


def test_pieces_of_names_meet_without_a_broadcast(spark):
    lines = spark.createDataFrame([("Line 4 to the east",), ("Unheard",)], "line string")
    groups = spark.createDataFrame([("A4", "G4", "Line 4", "Line 4 (West)")], "service string, group_id string, group_name string, name string")
    d = mj.candidate_services(lines, groups)
    assert "BroadcastExchange HashedRelationBroadcastMode(List(input[1, string" not in plan(d) and "SortMergeJoin [text" in plan(d)
    assert {(r.line, r.service) for r in d.collect()} == {("Line 4 to the east", "A4"), ("Unheard", None)}


def test_points_and_their_shapes_meet_without_a_broadcast(spark):
    points = spark.createDataFrame([("H", 0, 1.0, 1.0, 0), ("H", 1, 2.0, 1.0, 1), ("I", 0, 1.0, 1.0, 2)], "shape_id string, seq bigint, lat double, lon double, row_pos bigint")
    d = sh.usable_shapes(points)
    assert "Broadcast" not in plan(d)
    assert {(r.shape_id, r.seq) for r in d.collect()} == {("H", 0), ("H", 1)}
