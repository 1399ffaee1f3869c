"""Registered queries against their SQL cross-check, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from wayline import catalog
from wayline.adapters import BASE

FOLDER = "/root/testdata/sf0.001"
QUICK = ["ag1_signatures", "ag2_patterns", "wn1_position", "wn2_times_backwards", "bi1_agencies", "bi2_stops", "bi4_calendar", "bi10_trip_runs", "rc1_search", "rc4_multi_area",
         "rc8_metro_badges", "wn5_competition_rank", "jn5_nearest_stops", "jn6_footpaths", "jn8_services_on", "ag19_route_length", "fn1_display", "fn3_match_key", "fn9_stable_ids",
         "mg1_outcomes", "rc17_place_changes", "sl7_rc18_recent", "gr1_stations", "gr7_jn15_parent_links", "src11_src12_round_trip", "src9_steps", "geo11_ai4_area_verdicts", "jn16_probable_duplicates", "jn17_matched_stops", "gr6_path_services",
         "mj7_mj8_counts", "geo15_slices", "src13_line_reasons", "jn23_station_distances", "ai6_regions"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("WAYLINE_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "" if v is None else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    res = duck.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in res.description]
    assert sorted(cols) == order
    want = sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in res.fetchall())
    assert got == want


def test_every_query_has_a_cross_check():
    assert set(catalog.queries()) == set(catalog.oracles()) <= set(entry.queries())
