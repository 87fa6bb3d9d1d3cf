import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from kerbline.operators import graph
from kerbline.sources import closures, network, ridefiles, traffic, weather
from kerbline.streaming import ingest

RIDE = """app#1
key,lat,lon,ts,bike,childCheckBox,trailerCheckBox,pLoc,incident,i1,i2,i3,i4,i5,i6,i7,i8,i9,scary,desc,i10
0,,,1000,2,1,0,1,-5,,,,,,,,,,,,
1,52.5,13.4,2000,,,,,1,1,0,0,0,0,0,1,0,0,1,"a, b",0
2,52.6,13.5,3000,,,,,6

=========================
app#1
lat,lon,X,Y,Z,timeStamp,acc,a,b,c
52.50,13.40,1,2,3,5000,4.5,,,
,,1,2,3,4000,,,,
52.51,13.41,1,2,3,4500,7,,,
"""


@pytest.fixture()
def rides(tmp_path):
    folder = tmp_path / "Berlin" / "Rides" / "2024"
    folder.mkdir(parents=True)
    (folder / "VM2_1").write_text(RIDE)
    (folder / "VM2_2").write_text("key,lat,lon\n1,2,3\n")
    (folder / "VM2_3").write_text("\n \n")
    (folder / "VM2_6").write_text("")  # Spark's readers pass over files without a byte
    (folder / ".VM2_4").write_text("x")
    (folder / "other").write_text("x")
    (tmp_path / "VM2_5").write_text("outside")
    return str(tmp_path)


def test_ride_files(spark, rides):
    files = ridefiles.discover(spark, rides)
    assert [r.file for r in files.collect()] == ["VM2_1", "VM2_2", "VM2_3"]
    known = spark.createDataFrame([("VM2_2",)], "file string")
    assert [r.file for r in ridefiles.discover(spark, rides, known, 1).collect()] == ["VM2_1"]
    parts = ridefiles.sections(files)
    assert [r.file for r in parts.where(ridefiles.is_empty()).collect()] == ["VM2_3"]
    points = [(r.seq, r.lat, r.ts, r.gps_accuracy) for r in ridefiles.points(parts).orderBy("seq").collect()]
    assert points == [(0, 52.5, 5000, 4.5), (1, None, 4000, None), (2, 52.51, 4500, 7.0)]
    got = ridefiles.incidents(parts).where("file = 'VM2_1'").orderBy("seq").collect()
    assert [(r.incident_type, r.scary, r.description, r.participants) for r in got] == [("CLOSE_PASS", True, "a, b", ["BUS", "CAR"]), ("NEAR_DOORING", False, None, [])]
    facts = {r.file: r for r in ridefiles.ride_facts(parts).collect()}
    one = facts["VM2_1"]
    assert (one.bike_type, one.child_transport, one.trailer_attached, one.phone_location, one.start_ms, one.end_ms, len(one.trajectory)) == ("ROAD_RACING_BIKE", True, False, "HANDLEBAR", 5000, 4500, 2)
    assert set(facts) == {"VM2_1", "VM2_2"} and facts["VM2_2"].trajectory is None


def test_stream_equals_batch(spark, rides, tmp_path):
    ingest.import_rides(spark, rides, str(tmp_path / "out"), str(tmp_path / "state"), files_per_batch=1)
    batch = ridefiles.points(ridefiles.sections(ridefiles.discover(spark, rides)))
    streamed = spark.read.parquet(str(tmp_path / "out" / "points")).drop("batch")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    ingest.import_rides(spark, rides, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out" / "rides")).count() == 2


def test_hourly_stream(spark, tmp_path, sf_dir):
    from kerbline.plans.adapters import Ride

    events = Ride(spark, sf_dir).view("segment_events").select("event_type", F.timestamp_millis("event_ts").alias("at"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.hourly_counts(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hourly").agg(F.sum("n")).first()[0] == events.count()


def test_traffic_layouts(spark, tmp_path):
    new = tmp_path / "TE001.csv"
    new.write_text("Datum (Ortszeit);Stunde des Tages (Ortszeit);qkfz;vkfz;qpkw;vpkw;qlkw;vlkw;Vollstaendigkeit\n01.05.2024;7;100;31.5;90;;;nan;80\n2024-05-01;7;120;-1;;;;;75\n;7;1;1;;;;;1\n")
    got = traffic.measurements(traffic.read_csv(spark, str(new)), "NEW_DETECTOR").collect()
    assert [(r.key, str(r.day), r.hour, r.volume_kfz, r.speed_kfz, r.completeness, r.quality) for r in got] == [("te001", "2024-05-01", 7, 120, -1.0, 75.0, None)]
    old = tmp_path / "old.csv.gz"
    old.write_bytes(gzip.compress(b"detid_15;tag;stunde;qualitaet;q_kfz_det_hr;v_kfz_det_hr\nD1;01.05.2024;8;0.9;200;-1\n;01.05.2024;8;1;1;1\n"))
    got = traffic.measurements(traffic.read_csv(spark, str(old)), "OLD_DETECTOR").collect()
    assert [(r.key, r.volume_kfz, r.speed_kfz, r.quality) for r in got] == [("D1", 200, None, 0.9)]
    assert traffic.pick_archive(["det_2024_04s.tgz", "detectors_2024_05.tgz", "detector_2024_05.tgz"], "detector", "2024_05") == "detector_2024_05.tgz"
    assert traffic.pick_archive(["detectors_2024_05.tgz"], "detector", "2024_05") == "detectors_2024_05.tgz"


def test_archives(tmp_path):
    def pack(name, member):
        with tarfile.open(tmp_path / name, "w:gz") as tar:
            info = tarfile.TarInfo(member)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
        return str(tmp_path / name)

    assert [p.rsplit("/", 1)[1] for p in traffic.unpack_archive(pack("a.tgz", "x/y.csv"), str(tmp_path / "a"))] == ["y.csv"]
    with pytest.raises(ValueError):
        traffic.unpack_archive(pack("b.tgz", "../../y.csv"), str(tmp_path / "b"))


def test_detectors(spark):
    rows = spark.createDataFrame([("TE1", "1", 5.0, "Hauptstr.", "Nord", "13.4", "52.5", "01.02.2020", None), ("TE1", "2.0", 5.0, "Neue Str.", "Süd", "", "52.5", "2020-02-01", "ja"), (" ", "3", 1.0, "x", "x", "1", "1", None, None), ("TE2", None, None, None, None, "13.1", "52.1", None, "nein")], "DET_NAME_ALT string, DET_ID15 string, MQ_KURZNAME double, STRASSE string, RICHTUNG string, `LAENGE (WGS84)` string, `BREITE (WGS84)` string, INBETRIEBNAHME string, DEINSTALLIERT string").coalesce(1)
    got = {r.detector_key: r for r in traffic.detectors(rows).collect()}
    assert set(got) == {"TE1", "TE2"} and (got["TE1"].det_id15, got["TE1"].mq_name, got["TE1"].lon, str(got["TE1"].active_from), got["TE1"].removed) == ("2", "5", None, "2020-02-01", True)
    assert [r.detector_key for r in traffic.located_detectors(traffic.detectors(rows)).collect()] == ["TE2"]


def snapshot(id_, street, subtype="Baustelle", start="2024-10-21T05:10:00", tstore=None, end=None, geometry=None):
    return {"properties": {"id": id_, "tstore": tstore, "subtype": subtype, "severity": "Vollsperrung", "validity": {"from": start, "to": end}, "street": street, "content": "x"}, "geometry": geometry or {"type": "Point", "coordinates": [13.4, 52.5]}}


def test_closure_snapshots(spark, tmp_path):
    days = [
        [snapshot("source-1", "Alte Straße", tstore="2024-10-20T06:00:00Z"), snapshot("ended", "x", subtype="Beendet")],
        [snapshot("source-1", "Neue Straße", tstore="2024-10-22T06:00:00Z"), snapshot("source-1", "Neue Straße", start="01.11.2024 08:00")],
        [snapshot("source-1", "Neue Straße", subtype="Beendet", tstore="2024-10-23T06:00:00Z")],
    ]
    for i, d in enumerate(days):
        (tmp_path / f"incidents_viz_{i}.json").write_bytes(json.dumps({"features": d}, ensure_ascii=False).encode("iso-8859-1"))
    (tmp_path / "else.json").write_text("{}")
    got = closures.historical(spark, str(tmp_path)).orderBy("valid_from").collect()
    assert [(r.closure_street, r.valid_to, r.factor_type, r.severity) for r in got] == [("Neue Straße", 1729663200000, "CONSTRUCTION", "FULL_CLOSURE"), ("Neue Straße", None, "CONSTRUCTION", "FULL_CLOSURE")]
    assert got[0].feed_id == "historical:source-1:1729480200000"


def test_closure_feed_and_upsert(spark, tmp_path):
    mixed = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [13.318, 52.452]}, {"type": "LineString", "coordinates": [[13.3, 52.4], [13.4, 52.5]]}]}
    only = {"type": "LineString", "coordinates": [[13.4, 52.5], [13.5, 52.6]]}
    rows = [snapshot("a", "A", geometry=mixed), snapshot("b", "B", geometry=only), snapshot("c", "C", start=None), {**snapshot("d", "D"), "geometry": None}, snapshot(None, "E"), snapshot("a", "A2", geometry=mixed)]
    (tmp_path / "feed.json").write_text(json.dumps({"features": rows}))
    got = {r.feed_id: r for r in closures.live(closures.read(spark, str(tmp_path / "feed.json"))).collect()}
    assert set(got) == {"a", "b"} and (got["a"].lon, got["a"].lat, got["a"].closure_street, len(got["a"].lines)) == (13.318, 52.452, "A2", 1)
    assert (got["b"].lon, got["b"].lat) == (13.4, 52.5)
    known = spark.createDataFrame([("a", "old", 1, 1), ("z", "stays", 1, 1)], "feed_id string, content string, first_seen long, last_seen long")
    new = spark.createDataFrame([("a", None), ("n", "fresh")], "feed_id string, content string")
    merged = {r.feed_id: (r.content, r.first_seen, r.last_seen) for r in closures.upsert(known, new, 9).collect()}
    assert merged == {"a": (None, 1, 9), "z": ("stays", 1, 1), "n": ("fresh", 9, 9)}


def test_weather_answers(spark):
    body = json.dumps({"hourly": {"time": ["2024-07-01T10:00", "2024-07-01T11:00", "2024-07-01T12:00"], "temperature_2m": [20.5, 21.0], "weather_code": [1, None, 3]}})
    rows = weather.hourly(spark.createDataFrame([(52.5, 13.4, body), (1.0, 1.0, "broken")], "lat2 double, lon2 double, body string"), end=1719828000000).orderBy("hour_ms").collect()
    assert [(r.hour_ms, r.temperature_2m, r.weather_code, r.precipitation) for r in rows] == [(1719820800000, 20.5, 1, None), (1719824400000, 21.0, None, None)]


def osm(ways):
    nodes = {1: (52.5, 13.4), 2: (52.5, 13.402), 3: (52.501, 13.401)}
    text = "".join(f'<node id="{i}" lat="{a}" lon="{b}"/>' for i, (a, b) in nodes.items())
    for i, (refs, given) in enumerate(ways, 1):
        text += f'<way id="{i}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + "".join(f'<tag k="{k}" v="{v}"/>' for k, v in given.items()) + "</way>"
    return f"<osm>{text}</osm>"


@pytest.mark.parametrize(("direct", "ahead", "back"), [({"bicycle": "no"}, (240, 400), (240, 400)), ({"cycleway": "track"}, (130, 145), (130, 145)), ({"access": "private"}, (240, 400), (240, 400)), ({"oneway": "yes"}, (130, 145), (240, 400))])
def test_routing_access(spark, tmp_path, direct, ahead, back):
    (tmp_path / "m.osm").write_text(osm([([1, 2], {"highway": "residential", "name": "Short", **direct}), ([1, 3, 2], {"highway": "residential"})]))
    edges = network.edges(network.read_nodes(spark, str(tmp_path / "m.osm")), network.read_ways(spark, str(tmp_path / "m.osm"))).cache()
    trips = spark.createDataFrame([("there", 1, 2), ("back", 2, 1), ("nowhere", 1, 99), ("here", 1, 1)], "ride_id string, source long, target long")
    got = {r.ride_id: r for r in graph.shortest_paths(trips, edges).collect()}
    assert ahead[0] <= got["there"].shortest_distance <= ahead[1] and back[0] <= got["back"].shortest_distance <= back[1]
    assert got["nowhere"].shortest_distance is None and got["nowhere"].path_edges is None and got["here"].path_edges == []


def test_map_matching(spark):
    rows = [(i, i, i + 1, 100.0, True, True, [{"lon": 13.4 + i * 0.00148, "lat": 52.5}, {"lon": 13.4 + (i + 1) * 0.00148, "lat": 52.5}]) for i in range(5)]
    rows.append((9, 2, 77, 100.0, True, True, [{"lon": 13.4 + 2 * 0.00148, "lat": 52.5}, {"lon": 13.4 + 2 * 0.00148, "lat": 52.501}]))
    edges = spark.createDataFrame(rows, "edge_id int, from_node long, to_node long, metres double, forward boolean, backward boolean, line array<struct<lon:double,lat:double>>")
    points = [("r", 52.5 + (0.00003 if k % 2 else -0.00003), 13.4003 + k * 0.0007, k) for k in range(9)] + [("far", 50.0, 10.0, 1)]
    got = {r.ride_id: r.edge_ids for r in graph.match_rides(spark.createDataFrame(points, "ride_id string, lat double, lon double, ts long"), edges).collect()}
    assert got == {"r": [0, 1, 2, 3], "far": []}


def test_import_metrics(spark, rides, tmp_path):
    from kerbline.streaming.metrics import ImportMetrics, Progress

    listener, metrics = Progress(), ImportMetrics()
    spark.streams.addListener(listener)
    try:
        query = ingest.import_rides(spark, rides, str(tmp_path / "out"), str(tmp_path / "state"), 1, metrics)
    finally:
        spark.streams.removeListener(listener)
    got = metrics.summary()
    points = spark.read.parquet(str(tmp_path / "out" / "points")).count()
    incidents = spark.read.parquet(str(tmp_path / "out" / "incidents")).count()
    assert got["batches"] >= 3 and (got["files"], got["empty"], got["without_points"], got["points"], got["most_points"], got["incidents"]) == (3, 1, 1, points, 2, incidents)
    assert got["points_a_file"] == points / 2 and 0 < got["slowest"] <= got["seconds"] and got["seconds_a_batch"] > 0 and got["files_a_second"] > 0
    assert ImportMetrics().summary()["files_a_second"] is None
    seen = listener.queries.get(str(query.id))
    assert seen is None or seen["batches"] <= got["batches"]  # events come late, if at all before the listener goes


def test_match_metrics(spark):
    from kerbline.streaming import metrics as M

    rows = [("a", "PENDING", [1, 2, 3]), ("b", "SKIPPED", None), ("c", "PENDING", [1])]
    df, seen = M.observed_matches(spark.createDataFrame(rows, "ride_id string, status string, edge_ids array<int>"))
    assert df.count() == 3
    assert seen.get == {"matched": 2, "too_short": 1, "edges": 4, "most_edges": 3} and M.match_rate(5, seen) == 50.0 and M.match_rate(1, seen) is None


def test_registered_dimension_and_provider(spark):
    from pyspark.sql import functions as F

    from kerbline.operators import analytics as A
    from kerbline.operators import enrich as E

    rows = [(1, 7, "AVOIDANCE", 3), (2, 7, "PREFERENCE", 4), (3, 8, "PREFERENCE", 4)]
    events = spark.createDataFrame(rows, "event_id long, segment_id long, event_type string, month int").select("*", *(F.lit(1.0).alias(a) for a in A.AVERAGES[:5]))
    segments = spark.createDataFrame([(7, 1.0, 0.1, 0.2), (8, 1.0, 0.1, 0.2)], "segment_id long, gradient_percent double, avoidance_ratio double, preference_ratio double")
    E.register_provider("noise", lambda ev, seg: ev.select("event_id", (F.col("month") * 10).alias("noise")))
    A.register_dimension("NOISE", lambda: F.col("noise"))
    try:
        louder = E.provided(events, segments, ["noise"])
        assert {(r.value, r.total) for r in A.distribution(louder, segments, "NOISE").collect()} == {("30", 1), ("40", 2)}
        assert "NOISE" in A.dimensions() and E.provided(events, segments).columns[-1] == "noise"
        for wrong in (lambda: A.register_dimension("NOISE", lambda: F.lit(1)), lambda: A.register_dimension("LIT", lambda: F.lit(1)), lambda: E.register_provider("noise", None), lambda: E.provided(events, segments, ["none"])):
            with pytest.raises(ValueError):
                wrong()
    finally:
        E.unregister_provider("noise")
        A.unregister_dimension("NOISE")
    with pytest.raises(ValueError):
        A.distribution(events, segments, "NOISE")
