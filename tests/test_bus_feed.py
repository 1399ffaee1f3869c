"""A small feed with one bad row per rule, and the counters it must give."""

import pytest
from pyspark.sql import functions as F

from wayline.operators.accept import accepted
from wayline.adapters import Tables
from wayline.operators.ordered import WIDTH
from wayline.plans.bus_feed import Import, shapes, stop_ids, stops, trip_results

DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()


def table(spark, columns, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"`{c}` string" for c in columns.split()) + ", row_pos bigint")


@pytest.fixture(scope="module")
def feed(spark):
    week = ["1", "1", "1", "1", "1", "0", "0"]
    times = [("T1", "08:00:00", "08:00:30", "S1", "1"), ("T1", "08:05:00", "08:05:30", "S2", "2"), ("T1", "08:06:00", "08:06:30", "S3", "2"),
             ("T1", "xx:yy", "08:09:00", "S3", "3"), ("T1", "08:10:00", "08:10:10", "S?", "4"), ("T1", "08:10:00", "08:10:10", "S3", "-1"),
             ("T2", "23:50:00", "23:50:00", "S1", "1"), ("T2", "25:10:00", "25:10:00", "S2", "2"),
             ("T3", "09:00:00", "09:00:00", "S1", "1"), ("T4", "10:00:00", "10:00:00", "S1", "1"), ("T4", "09:00:00", "09:00:00", "S2", "2"),
             ("T9", "10:00:00", "10:00:00", "S1", "1"), ("T1", "11:00:00", "11:00:00", "S3", "9")]
    return Import(
        table(spark, "agency_id agency_name", [("A1", "One"), ("A1", "Again"), ("A2", " ")]),
        table(spark, "stop_id stop_name stop_lat stop_lon location_type wheelchair_boarding",
              [("S1", "A", "abc", "77", "", ""), ("S1", "First", "28.1", "77.1", "", "1"), ("S1", "Second", "28.2", "77.2", "", ""), ("S2", "B", "28.2", "77.2", "0", "2"),
               ("S3", "C", "28.3", "77.3", "", ""), ("S4", "D", "0", "0", "", ""), ("S5", "E", "51.5", "0.1", "", ""), ("S6", "", "28", "77", "", ""), ("S7", "F", "28.4", "77.4", "1", "")]),
        table(spark, "route_id route_long_name route_short_name agency_id route_type route_color",
              [("R1", "Main", "", "A1", "3", "00ff00"), ("R2", "", "", "A1", "3", ""), ("R3", "X", "", "A9", "3", ""), ("R4", "Y", "", "", "bus", ""), ("R5", "Idle", "", "", "3", "")]),
        table(spark, "service_id start_date end_date " + " ".join(DAYS), [("C1", "20260101", "20261231", *week), ("C2", "20260601", "20260101", *week)]),
        table(spark, "service_id date exception_type", [("C1", "20260302", "2"), ("C7", "20260303", "1"), ("C1", "20260304", "9")]),
        table(spark, "shape_id shape_pt_lat shape_pt_lon shape_pt_sequence", [("H1", "28.2", "77.2", "2"), ("H1", "28.1", "77.1", "1"), ("H1", "95", "77", "3"), ("H2", "28", "77", "1")]),
        table(spark, "trip_id route_id service_id shape_id trip_headsign direction_id",
              [("T1", "R1", "C1", "H1", "Town", "0"), ("T1", "R1", "C1", "", "", ""), ("T2", "R1", "C7", "H2", "", "7"), ("T3", "R1", "C1", "", "", ""), ("T4", "R1", "C1", "", "", ""),
               ("T5", "R1", "C1", "", "", ""), ("T6", "R9", "C1", "", "", ""), ("T7", "R1", "C9", "", "", "")]),
        table(spark, "trip_id arrival_time departure_time stop_id stop_sequence", times))


def test_counters(feed):
    n = {(r.tbl, r.outcome, r.reason): r.n for r in feed.statistics().collect()}
    ok = {t: n.get((t, "accepted", "")) for t in ("agency", "stops", "routes", "calendar", "calendar_dates", "shapes", "trips", "trip_results")}
    assert ok == {"agency": 1, "stops": 3, "routes": 2, "calendar": 1, "calendar_dates": 2, "shapes": 1, "trips": 5, "trip_results": 2}
    for key in (("stops", "rejected", "invalid coordinates"), ("stops", "duplicate", ""), ("stops", "skipped", ""), ("trips", "duplicate", "")):
        assert n[key] == {"invalid coordinates": 2}.get(key[2], 1)
    reasons = {r for (_, o, r) in n if o == "rejected"}
    assert reasons >= {"stop without a name", "coordinates outside the supported region", "route without a name", "route of an unknown agency", "invalid route type",
                       "service ends before it starts", "invalid calendar date entry", "invalid shape point", "shape with fewer than two points", "trip of an unknown route",
                       "trip of an unknown service", "malformed stop time", "stop time of an unknown stop", "invalid stop sequence", "stop time of an unknown trip",
                       "trip with fewer than two valid stop times", "trip with times going backwards", "trip without stop times", "stop times of a trip are not contiguous"}


def test_a_bad_first_copy_does_not_block_a_good_one(feed):
    assert accepted(feed.stops).filter("stop_id = 'S1'").first().name == "First"


def test_past_midnight_and_usage(feed):
    late = feed.accepted_stop_times().agg(F.max("arrival_s")).first()[0]
    assert late == 25 * 3600 + 600
    use = {r.what: r.n for r in feed.usage().collect()}
    assert use["routes without trips"] == 1 and use["unused stops"] == 1 and use["shape references cleared"] == 1
    assert feed.service_period().first().days == "monday,tuesday,wednesday,thursday,friday"


def test_trips_and_shapes_are_judged_across_stretches(spark):
    far = WIDTH * 3
    rows = [("T1", 1, 10, 20), ("T1", 2, None, None), ("T1", far, None, 15), ("T2", 1, 10, 20), ("T2", far, 20, None), ("T2", far + 1, None, None), ("T3", 1, 5, 5)]
    rows = [(t, s, a, d, "accepted") for t, s, a, d in rows] + [("T3", None, 9, 9, "rejected"), ("T4", None, None, None, "rejected"), ("T5", 1, 1, 1, "ignored")]
    times = spark.createDataFrame(rows, "trip_id string, seq int, arrival_s int, departure_s int, outcome string")
    ids = spark.createDataFrame([(f"T{i}",) for i in range(1, 7)], "trip_id string")
    got = {r.trip_id: (r.rows, r.reason) for r in trip_results(times, ids).collect()}
    few, none = "trip with fewer than two valid stop times", "trip without stop times"
    assert got == {"T1": (3, "trip with times going backwards"), "T2": (3, None), "T3": (1, few), "T4": (0, few), "T5": (0, none), "T6": (0, none)}
    at = lambda shape, seq, lat: (shape, str(lat), "77", str(seq))
    points = [at("H1", 1, 28), at("H1", 1, 29), at("H1", 2, 28), at("H1", far, 28), at("H2", 5, 28), at("H2", far, 28), at("H2", far + 1, 30), at("H2", 2 * far, 28), at("H3", 1, 99)]
    raw = table(spark, "shape_id shape_pt_lat shape_pt_lon shape_pt_sequence", points)
    assert {r.shape_id: (r.points, r.outcome) for r in shapes(raw).collect()} == {"H1": (1, "rejected"), "H2": (3, "accepted")}


def test_accepted_keys_are_those_of_the_accepted_rows(spark):
    raw = table(spark, "stop_id stop_name stop_lat stop_lon location_type wheelchair_boarding", [
        ("S1", "A", "abc", "77", "", ""), ("S1", "B", "28", "77", "", ""), ("S1", "C", "28", "77", "", ""), ("S2", "D", "28", "77", "1", ""), ("", "E", "28", "77", "", ""),
        ("S3", "", "28", "77", "", ""), ("S4", "F", "28", "77", "2", ""), ("S4", "F", "28", "77", "0", "")])
    assert sorted(r.stop_id for r in stop_ids(raw).collect()) == sorted({r.stop_id for r in accepted(stops(raw)).collect()}) == ["S1", "S4"]


def test_kept_views_are_made_once(spark):
    t = Tables(spark, "nowhere")
    t._made["a_line"] = spark.createDataFrame([(1, 2, 3, 1, 5.0, 0, 0)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, pos int, off bigint")
    t.keep("a_line")
    files = t.a_line.inputFiles()
    assert files and t.raw_stop_time.inputFiles() == t.raw_shape.inputFiles() == t.raw_stop.inputFiles() == files
    assert t.raw_stop_time.first().trip_id == "T1"
