"""Files: delimited tables, zipped feeds, map extracts, and publishing."""

import zipfile

import pytest

from wayline.plans import merge
from wayline.sources import gtfs, osm


def test_table_scan(spark, tmp_path):
    f = tmp_path / "stops.txt"
    f.write_text('﻿stop_id, stop_name\nS1," A ""q"", x "\n\nS2\n', encoding="utf-8")
    rows = gtfs.table(spark, str(f), ["stop_id", "stop_name"], ["zone_id"]).orderBy("row_pos").collect()
    assert [(r.stop_id, r.stop_name, r.zone_id) for r in rows] == [("S1", 'A "q", x', ""), ("S2", "", "")]
    with pytest.raises(ValueError):
        gtfs.table(spark, str(f), ["stop_id", "stop_lat"])
    assert gtfs.table(spark, str(tmp_path / "none.txt"), ["a"]).count() == 0
    with pytest.raises(FileNotFoundError):
        gtfs.table(spark, str(tmp_path / "none.txt"), ["a"], needed=True)


def test_unzip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("trips.txt", "trip_id\nT1\nT2\n")
    gtfs.unzip(spark, str(tmp_path / "feed.zip"), str(tmp_path / "out"))
    assert gtfs.table(spark, str(tmp_path / "out" / "member=trips.txt"), ["trip_id"]).count() == 2


def test_map_extract(spark, tmp_path):
    f = tmp_path / "a.osm"
    f.write_text("""<osm><node id="9" lat="1" lon="2"><tag k="place" v="town"/></node>
<way id="5"><nd ref="1" lat="0" lon="0"/><nd ref="2"/><tag k="place" v="suburb"/></way>
<relation id="7"><member type="way" ref="1" role="outer"><nd lat="0" lon="0"/><nd lat="0" lon="1"/></member><member type="way" ref="2" role="inner"><nd lat="0" lon="0"/></member>
<member type="relation" ref="8" role="subarea"/><tag k="name" v="X"/></relation></osm>""")
    got = {r.kind: r for r in osm.elements(spark, str(f)).collect()}
    assert got["relation"].subareas == [8] and len(got["relation"].outer) == 1 and len(got["relation"].inner) == 1 and not got["relation"].incomplete
    assert got["way"].incomplete and got["node"].tags == {"place": "town"}


def test_publish_switches_versions(spark, tmp_path):
    merge.publish({"t": spark.range(2)}, str(tmp_path), "v1")
    merge.publish({"t": spark.range(5)}, str(tmp_path), "v2")
    assert merge.current(spark, str(tmp_path), "t").count() == 5
