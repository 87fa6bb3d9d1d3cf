import pytest
from pyspark.sql import functions as F

from kerbline.operators import analytics as A
from kerbline.operators import enrich as E
from kerbline.operators import exports as X
from kerbline.operators import rides as RD
from kerbline.operators.filters import EventFilter

LINE = "array<struct<lon:double,lat:double>>"


def line(*p):
    return [{"lon": float(x), "lat": float(y)} for x, y in p]


@pytest.fixture(scope="module")
def network(spark):
    """Edges 1-3 along a street, 11, 4 and 12 a way around the middle, 6 a copy of edge 2 a few metres off."""
    rows = [
        (1, "A", line((13.400, 52.5), (13.402, 52.5))), (2, "A", line((13.402, 52.5), (13.404, 52.5))), (3, "A", line((13.404, 52.5), (13.406, 52.5))),
        (11, "B", line((13.4015, 52.5), (13.4015, 52.503))), (4, "B", line((13.4015, 52.503), (13.4045, 52.503))), (12, "B", line((13.4045, 52.503), (13.4045, 52.5))), (6, "C", line((13.402, 52.5001), (13.404, 52.5001))),
    ]
    return spark.createDataFrame(rows, f"edge_id int, street_name string, line {LINE}").withColumn("gradient_percent", F.lit(1.0))


def ride(spark, **over):
    base = {"ride_id": "r", "located": 3, "edge_ids": [1, 11, 4, 12, 3], "path_edges": [1, 2, 3], "trajectory": line((13.400, 52.5), (13.4015, 52.5), (13.4015, 52.503), (13.4045, 52.503), (13.4045, 52.5), (13.406, 52.5)), "shortest_line": line((13.400, 52.5), (13.406, 52.5)), "actual_distance": 1000.0, "shortest_distance": 400.0, "start_ms": 1719817200000, "end_ms": 1719818400000, "child_transport": None, "trailer_attached": None, "bike_type": "OTHER"} | over
    return spark.createDataFrame([base], f"ride_id string, located int, edge_ids array<int>, path_edges array<int>, trajectory {LINE}, shortest_line {LINE}, actual_distance double, shortest_distance double, start_ms long, end_ms long, child_transport boolean, trailer_attached boolean, bike_type string")


@pytest.mark.parametrize(("over", "status", "kind"), [({}, "PROCESSED", "LOCAL_DETOUR"), ({"actual_distance": 430.0}, "PROCESSED", "EQUIVALENT_ROUTE"), ({"located": 1}, "SKIPPED", None), ({"edge_ids": []}, "SKIPPED", None), ({"shortest_distance": None}, "SKIPPED", None), ({"actual_distance": -1.0}, "ERROR", None), ({"trajectory": line((14, 53), (14.1, 53))}, "PROCESSED", "CORRIDOR_ALTERNATIVE")])
def test_comparison(spark, over, status, kind):
    r = RD.compare_rides(ride(spark, **over)).first()
    assert (r.status, r.route_comparison_type) == (status, kind)


def test_events_of_detours(spark, network):
    compared = RD.compare_rides(ride(spark))
    points = spark.createDataFrame([("r", i, 52.5 + (0.003 if i == 2 else 0), 13.4 + i * 0.002, 1719817200000 + i * 1000) for i in range(4)], "ride_id string, seq int, lat double, lon double, ts long")
    moments = RD.edge_moments(compared.withColumn("edge_ids", F.array_union("edge_ids", "path_edges")), points, network)
    events = RD.register_events(compared, network, moments)
    got = sorted((r.segment_id, r.event_type, r.ride_intent == compared.first().ride_intent, r.day_of_week) for r in events.collect())
    assert got == [(2, "AVOIDANCE", True, "MONDAY"), (4, "PREFERENCE", True, "MONDAY")]
    assert RD.failed_rides(events).count() == 0
    assert RD.register_events(RD.compare_rides(ride(spark, actual_distance=430.0)), network, moments).count() == 0
    lost = RD.register_events(RD.compare_rides(ride(spark, start_ms=None)), network, moments.limit(0))
    assert [r.ride_id for r in RD.failed_rides(lost).collect()] == ["r"]


def test_edges_nearby_are_not_apart(spark, network):
    two = ride(spark, edge_ids=[1, 6, 3], trajectory=line((13.4, 52.5), (13.402, 52.5001), (13.404, 52.5001), (13.406, 52.5)))
    assert RD.apart_edges(two, network, "path_edges", "edge_ids", "trajectory").count() == 0
    gone = RD.apart_edges(ride(spark, edge_ids=[1, 3, 99]), network, "edge_ids", "path_edges", "shortest_line")
    assert [(r.ride_id, r.edge_id) for r in gone.collect()] == [("r", 99)]


def test_short_ride(spark):
    points = spark.createDataFrame([("a", 0, 52.52, 13.405, 1000), ("a", 1, 52.5205, 13.4055, 2000), ("b", 0, 52.52, 13.405, 1), ("b", 1, 52.53, 13.405, 2), ("b", 2, 0.0, 13.0, 3)], "ride_id string, seq int, lat double, lon double, ts long")
    assert {r.ride_id: r.skip for r in RD.too_short(points).collect()} == {"a": True, "b": False}


def test_counters_and_segments(spark, network):
    rides = ride(spark, edge_ids=[1, 2, 1])
    assert {r.segment_id: r.usage_count for r in RD.usage_counts(rides).collect()} == {1: 2, 2: 1}
    known = spark.createDataFrame([(1,)], "segment_id long")
    assert sorted(r.segment_id for r in RD.new_segments(known, rides, network).collect()) == [2, 3]
    old = spark.createDataFrame([(1, "A", None, 7.0, 5)], f"segment_id long, street_name string, line {LINE}, gradient_percent double, usage_count long")
    fresh = spark.createDataFrame([(1, "X", None, None), (2, "B", None, 3.0)], f"segment_id long, street_name string, line {LINE}, gradient_percent double")
    assert sorted((r.segment_id, r.street_name, r.gradient_percent, r.usage_count) for r in RD.upsert_segments(old, fresh).collect()) == [(1, "A", 7.0, 5), (2, "B", 3.0, None)]


def test_zero_filled_summary(spark):
    rides = spark.createDataFrame([("PENDING", None)], "status string, route_comparison_type string")
    segments = spark.createDataFrame([], "usage_count long, avoidance_count long")
    events = spark.createDataFrame([], "event_type string, traffic_status string, event_ts long")
    got = {(r.counter, r.value): r.n for r in A.summary(rides, segments, events).collect()}
    assert got["ride_status", "PENDING"] == 1 and got["ride_status", "ERROR"] == 0 and got["segments", "total"] == 0 and got["events", "first"] is None and len(got) == 16


def test_signals_fixture(spark):
    rows = [(f"r{i}", "AVOIDANCE" if i < 8 else "PREFERENCE", " Sett ") for i in range(10)] + [(f"q{i}", "AVOIDANCE" if i < 3 else "PREFERENCE", "asphalt") for i in range(10)] + [("x", "AVOIDANCE", "unknown"), ("y", "AVOIDANCE", None)]
    events = spark.createDataFrame(rows, "ride_id string, event_type string, surface string").withColumn("ohsome_enriched", F.lit(True))
    got = A.infrastructure_signals(events, "SURFACE").collect()
    assert [(r.value, r.avoidance, r.preference) for r in got] == [("sett", 8, 2), ("asphalt", 3, 7)]
    assert abs(got[0].baseline - 11 / 20) < 1e-12 and abs(got[0].difference - 25.0) < 1e-9 and abs(got[0].coverage - 20 / 22) < 1e-12
    with pytest.raises(ValueError):
        A.infrastructure_signals(events, "WEATHER_CODE")
    with pytest.raises(ValueError):
        A.context(events, EventFilter(start=2000, end=1000))
    with pytest.raises(ValueError):
        A.distribution(events, events, "COLOUR")


def test_missing_and_unknown_stay_apart(spark):
    rows = [(1, "AVOIDANCE", None), (1, "AVOIDANCE", "UNKNOWN"), (1, "PREFERENCE", "UNKNOWN")]
    events = spark.createDataFrame(rows, "segment_id long, event_type string, cycleway_type string")
    events = events.select("*", *(F.lit(1.0).alias(a) for a in A.AVERAGES[:5]))
    segments = spark.createDataFrame([(1, None, None, None)], "segment_id long, gradient_percent double, avoidance_ratio double, preference_ratio double")
    got = A.distribution(events, segments, "CYCLEWAY_TYPE").collect()
    assert [(r.value, r.total) for r in got] == [("UNKNOWN", 2), ("UNKNOWN", 1)]


def test_corridor_bounds(spark, network):
    got = A.corridor_geometry(network.union(network), " a ", 13.401, 52.499, 13.4045, 52.501).first()
    assert got.edge_ids == [1, 2, 3] and len(got.lines) == 3
    for bad in ((2.0, 1.0, 1.0, 3.0), (13.0, 52.0, 13.5, 52.1), (float("nan"), 1.0, 2.0, 3.0)):
        with pytest.raises(ValueError):
            A.corridor_geometry(network, "a", *bad)


def test_closure_near_segment(spark):
    segments = spark.createDataFrame([(42, "Weg", line((13.0, 52.0), (13.01, 52.0)))], f"segment_id long, street_name string, line {LINE}")
    closures = spark.createDataFrame([("c", "CONSTRUCTION", "VIZ", "Weg", 1000, 3000, 13.005, 52.0001), ("d", "CONSTRUCTION", "VIZ", "", 1000, None, 13.005, 52.0001), ("e", "HAZARD", "VIZ", "Weg", None, None, 13.005, 52.0001), ("f", "HAZARD", "VIZ", "Weg", 1000, None, 13.005, 52.001)], "feed_id string, factor_type string, source string, closure_street string, valid_from long, valid_to long, lon double, lat double")
    events = spark.createDataFrame([(1, 42, 1500)], "event_id long, segment_id long, event_ts long")
    got = E.closures_at(events, segments, closures).collect()
    assert [(r.segment_id, r.feed_id, r.valid_from) for r in got] == [(42, "c", 1000)]
    known = spark.createDataFrame([(42, "CONSTRUCTION", 1000)], "segment_id long, factor_type string, valid_from long")
    assert E.closures_at(events, segments, closures, known).count() == 0


def test_tags_as_of(spark):
    segments = spark.createDataFrame([(1, "Weg", line((13.0, 52.0), (13.001, 52.0)))], f"segment_id long, street_name string, line {LINE}")
    near, far = line((13.0, 52.00005), (13.001, 52.00005)), line((13.0, 52.01), (13.001, 52.01))
    ways = spark.createDataFrame([(5, 0, None, near, {"name": "Else", "surface": "sett"}), (6, 0, 100, near, {"name": "Weg", "surface": "asphalt"}), (7, 0, None, far, {"name": "Weg"})], f"way_id long, valid_from long, valid_to long, line {LINE}, tags map<string,string>")
    events = spark.createDataFrame([(1, 1, 50), (2, 1, 100), (3, 9, 50)], "event_id long, segment_id long, event_ts long")
    got = {r.event_id: (r.surface, r.ohsome_enriched) for r in E.enrich_tags(events, segments, ways).collect()}
    assert got == {1: ("asphalt", True), 2: ("sett", True), 3: (None, True)}


def test_calibration_csv(spark, tmp_path):
    sample = spark.createDataFrame([("a", 1, "LOCAL_DETOUR", 1200.0, 1000.0, 200.0, 0.2, 0.55, 7.5, 42)], "ride_id string, start_ms long, route_comparison_type string, actual_distance double, shortest_distance double, excess_distance double, excess_ratio double, overlap_ratio double, median_accuracy double, points long")
    X.write_calibration(X.calibration_rows(sample, F.lit("LINESTRING(1 2,3 4)"), F.lit(None).cast("string")), str(tmp_path / "c"))
    header, row = next((tmp_path / "c").glob("*.csv")).read_text().splitlines()
    assert header.count(",") == 13 and '"LINESTRING(1 2,3 4)"' in row and row.endswith('"","",""')


def test_features(spark, tmp_path):
    segments = spark.createDataFrame([(42, None, 10, 5, 2, 0.33, 0.2, 1.5, line((13.1234567, 52.0), (13.2, 52.1))), (43, "x", 1, 1, 1, None, None, None, None)], f"segment_id long, street_name string, usage_count long, avoidance_count long, preference_count long, avoidance_ratio double, preference_ratio double, gradient_percent double, line {LINE}")
    import json

    got = [json.loads(r.feature) for r in X.map_features(segments).collect()]
    assert len(got) == 1 and got[0]["properties"]["totalObservationCount"] == 15 and got[0]["properties"]["streetName"] is None and got[0]["geometry"]["coordinates"][0] == [13.123457, 52.0] and len(got[0]["properties"]) == 10
    events = spark.createDataFrame([(42, "AVOIDANCE", 1577836800000, True, False, False, "ENRICHED")], "segment_id long, event_type string, event_ts long, traffic_enriched boolean, weather_enriched boolean, ohsome_enriched boolean, traffic_status string")
    X.write_features(X.tile_features(segments, events, [2019, 2020]), str(tmp_path / "t"))
    p = json.loads(spark.read.text(str(tmp_path / "t")).first()[0])["properties"]
    assert p["eventCount_2020"] == 1 and p["bucket_2020"] == "AVOIDANCE_LIGHT" and "eventCount_2019" not in p and "streetName" not in p and p["trafficMeasuredEventCount"] == 1


def test_names_of_unnamed_edges(spark):
    rows = [
        (1, None, line((13.400, 52.5), (13.401, 52.5), (13.402, 52.5))),  # its middle vertex is the second
        (2, "Far", line((13.4012, 52.5), (13.402, 52.5))), (3, "Near", line((13.4011, 52.5), (13.402, 52.5))), (4, "Near too", line((13.4011, 52.5), (13.402, 52.6))),
        (5, " ", line((13.5, 52.5), (13.51, 52.5))), (6, "Long", line((13.3, 52.5101), (13.6, 52.5101))), (7, "", line((13.45, 52.51), (13.451, 52.51))), (8, "Own", line((13.401, 52.5))), (9, None, None),
    ]
    edges = spark.createDataFrame(rows, f"edge_id long, street_name string, line {LINE}").withColumn("d", F.lit(1))
    got = RD.named_edges(edges, edges)
    assert got.columns == ["edge_id", "street_name", "line", "d"]
    assert {r.edge_id: r.street_name for r in got.collect()} == {1: "Near", 2: "Far", 3: "Near", 4: "Near too", 5: "Unknown", 6: "Long", 7: "Long", 8: "Own", 9: "Unknown"}
    assert RD.named_edges(edges.limit(0), edges).count() == 0


def test_match_pending(spark):
    at = lambda i: 13.4 + i * 0.00148
    # edge 2 is drawn against the way of riding
    rows = [(i, *((i + 1, i) if i == 2 else (i, i + 1)), 100.0, True, True, line((at(i + 1), 52.5), (at(i), 52.5)) if i == 2 else line((at(i), 52.5), (at(i + 1), 52.5))) for i in range(6)]
    edges = spark.createDataFrame(rows, f"edge_id long, from_node long, to_node long, metres double, forward boolean, backward boolean, line {LINE}")
    ridden = [("r", k, 52.5 + (0.00003 if k % 2 else -0.00003), 13.4003 + k * 0.0007, 1000 * k) for k in range(12)]
    others = [("short", 0, 52.5, 13.4, 1), ("short", 1, 52.5, 13.401, 2), ("one", 0, 52.5, 13.4, 1), ("one", 1, 0.0, 13.5, 2), ("far", 0, 50.0, 10.0, 1), ("far", 1, 50.1, 10.0, 2), ("none", 0, None, 13.4, 1)]
    points = spark.createDataFrame(ridden + others, "ride_id string, seq int, lat double, lon double, ts long")
    got = {r.ride_id: r for r in RD.match_pending(points, edges).collect()}
    assert set(got) == {"r", "short"} and got["short"].status == "SKIPPED" and got["short"].edge_ids is None
    r = got["r"]
    assert r.status == "PENDING" and r.edge_ids == [0, 1, 2, 3, 4, 5] and r.actual_distance == 600.0
    assert [round(v.lon, 5) for v in r.trajectory] == [round(at(i), 5) for i in range(7)]
    assert [t.edge_id for t in r.traversals] == r.edge_ids and all(abs(t.bearing - 90) < 0.1 for t in r.traversals)
    # the middle vertex of two is the second as ridden
    want = [min(ridden, key=lambda p: abs(p[3] - at(i + 1)))[4] for i in range(6)]
    assert [t.ts for t in r.traversals] == want
    assert RD.match_pending(points.limit(0), edges).count() == 0
