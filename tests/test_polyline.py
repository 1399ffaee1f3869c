"""Polylines are decoded row by row; only points are shuffled."""

from wayline.sources import polyline as pl


def test_texts_decode_or_are_rejected_with_a_reason(spark):
    texts = [(1, "_p~iF~ps|U_ulLnnqC_mqNvxq`@"), (2, "_p~iF"), (3, ""), (4, None), (5, "_p~iF~ps|U_ulL_"), (6, "a\nb c"), (7, "????"), (8, "_" * 20 + "?_p~iF"), (9, "_p~iF~ps|U")]
    good, bad = pl.decode(spark.createDataFrame(texts, "route_id bigint, encoded string"))
    assert sorted((r.route_id, r.seq, r.lat, r.lon) for r in good.collect()) == [(1, 0, 38.5, -120.2), (1, 1, 40.7, -120.95), (1, 2, 43.252, -126.453)]
    assert {r.route_id: r.reason for r in bad.collect()} == {2: "MALFORMED", 3: "MISSING", 4: "MISSING", 5: "MALFORMED", 6: "MALFORMED", 7: "NO_LENGTH", 8: "MALFORMED", 9: "TOO_FEW_POINTS"}
