import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbline.functions import geo as G
from kerbline.functions import rules as R
from kerbline.operators import filters as FL
from kerbline.operators.filters import EventFilter


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def line(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points))


def test_route_comparison(spark):
    cases = [(1100.0, 1000.0, 0.20), (1100.01, 1000.0, 0.30), (1100.01, 1000.0, 0.2999), (1000.0, 0.0, 0.5), (-1.0, 1.0, 0.5), (float("nan"), 1.0, 0.5), (1.0, 1.0, 1.5)]
    got = [one(spark, R.route_comparison(*map(F.lit, case)))[0] for case in cases]
    assert got == ["EQUIVALENT_ROUTE", "LOCAL_DETOUR", "CORRIDOR_ALTERNATIVE", None, None, None, None]


NAMES = {"start_ms": "long", "end_ms": "long", "actual_distance": "double", "shortest_distance": "double", "route_comparison_type": "string", "is_detour": "boolean", "overlap_ratio": "double", "child_transport": "boolean", "trailer_attached": "boolean", "bike_type": "string", "status": "string"}


def intent(spark, **given):
    columns = {n: F.lit(given.get(n)).cast(t) for n, t in NAMES.items()}
    return one(spark, R.ride_intent(columns), R.ride_intent_score(columns))


def test_ride_intent(spark):
    assert intent(spark, status="PROCESSED", route_comparison_type="CORRIDOR_ALTERNATIVE") == ("LEISURE", -3)
    assert intent(spark, status="PROCESSED", route_comparison_type="LOCAL_DETOUR") == ("UNKNOWN", -1)
    assert intent(spark, status="PENDING", route_comparison_type="CORRIDOR_ALTERNATIVE")[0] == "UNKNOWN"
    monday_eight = 1719817200000  # 2024-07-01 09:00 in Berlin
    assert intent(spark, status="PROCESSED", start_ms=monday_eight, end_ms=monday_eight + 20 * 60_000)[1] == 2
    assert intent(spark, status="PROCESSED", start_ms=monday_eight - 60_000, end_ms=monday_eight + 20 * 60_000, actual_distance=6000.0)[1] == 4
    evening = monday_eight + 10 * 3_600_000 + 30 * 60_000  # 19:30
    assert intent(spark, start_ms=evening, end_ms=evening)[1] == 2 and intent(spark, start_ms=evening + 60_000, end_ms=evening + 60_000)[1] == 1
    assert intent(spark, is_detour=False)[1] == 1 and intent(spark, is_detour=True)[1] == -1
    assert intent(spark, actual_distance=150.0, shortest_distance=100.0, child_transport=True, trailer_attached=True, bike_type="MOUNTAIN_BIKE")[1] == -3


def test_wind_traffic_detectors(spark):
    wind = lambda b, w: one(spark, R.wind_exposure(F.lit(b).cast("double"), F.lit(w).cast("double")))[0]
    assert [wind(0, 45), wind(0, 46), wind(350, 10), wind(0, 135), wind(0, 180), wind(None, 5), wind(5, None)] == ["HEADWIND", "CROSSWIND", "HEADWIND", "TAILWIND", "TAILWIND", None, None]
    jam = lambda v, s: one(spark, R.traffic_condition(F.lit(v).cast("int"), F.lit(s).cast("double")))[0]
    assert [jam(None, None), jam(151, 20), jam(150, 20), jam(800, None), jam(100, None), jam(100, 31), jam(151, 31), jam(None, 31)] == ["UNKNOWN", "CONGESTED", "HEAVY", "HEAVY", "LIGHT", "LIGHT", "MODERATE", "MODERATE"]
    score = lambda r, m, d: one(spark, R.detector_score(F.lit(r), F.lit(m), F.lit(d).cast("double")))[0]
    assert [score(0, True, 45), score(2, False, 90), score(40, False, 135), score(0, False, None)] == [145.0, 102.0, -20.0, 100.0]
    good = lambda *x: one(spark, R.measurement_usable(*(F.lit(v) for v in x)))[0]
    none = F.lit(None).cast("double")
    assert good("NEW_DETECTOR", 5, 50.0, none, 75.0) and not good("NEW_DETECTOR", 5, 50.0, none, 74.9)
    assert not good("OLD_MQ", 5, 161.0, 0.8, none) and not good("OLD_MQ", -1, 50.0, 0.8, none) and not good("OLD_DETECTOR", 5, 50.0, none, none)


def test_streets_and_directions(spark):
    traffic = lambda a, b: one(spark, R.traffic_streets_match(F.lit(a), F.lit(b)))[0]
    closure = lambda a, b: one(spark, R.closure_streets_match(F.lit(a), F.lit(b)))[0]
    assert traffic("Hauptstr.", "hauptstraße 5") and traffic("Hauptstrasse", "HAUPTSTR.") and not traffic("", "x") and not traffic("Unknown", "unknown") and not traffic(None, "x")
    assert closure("", "x") and closure("Unknown", "x") and closure(None, "x") and closure("Hauptstr.", "Hauptstraße") and not closure("Hauptstrasse", "Hauptstraße")
    assert one(spark, R.direction_degrees(F.lit(" SÜDOST ")), R.direction_degrees(F.lit("suedwest")), R.direction_degrees(F.lit("x"))) == (135.0, 225.0, None)


def test_times(spark):
    assert one(spark, R.day_of_week(F.lit(1645804575000)), R.hour_of_day(F.lit(1645804575000))) == ("FRIDAY", 16)
    local = lambda t: one(spark, R.local_text_ms(F.lit(t)))[0]
    assert [local("21.10.2024 05:10"), local("2024-10-27T02:30:00"), local("2024-03-31T02:30"), local("soon")] == [1729480200000, 1729989000000, 1711848600000, None]
    assert one(spark, R.hour_floor(F.lit(-1)), R.hour_floor(F.lit(7_200_001))) == (0, 7_200_000)
    assert one(spark, R.instant_ms(F.lit("2024-10-23T06:00:00Z")), R.instant_ms(F.lit("23.10.2024"))) == (1729663200000, None)


def test_tolerant_scalars(spark):
    number = lambda t: one(spark, R.tolerant_double(F.lit(t)), R.tolerant_int(F.lit(t)))
    assert [number(" 1.9 "), number("nan"), number(""), number("x"), number("-1")] == [(1.9, 1), (None, None), (None, None), (None, None), (-1.0, -1)]
    date = lambda t: str(one(spark, R.tolerant_date(F.lit(t)))[0])
    assert [date("03.02.2024"), date("2024-02-03"), date("x")] == ["2024-02-03", "2024-02-03", "None"]


@pytest.mark.parametrize(("a", "p", "label"), [(0, 0, "NO_EVENTS"), (2, 0, "AVOIDANCE_LIGHT"), (3, 0, "AVOIDANCE"), (8, 0, "AVOIDANCE_STRONG"), (45, 0, "AVOIDANCE_EXTREME"), (0, 45, "PREFERENCE_EXTREME"), (0, 8, "PREFERENCE_STRONG"), (0, 7, "PREFERENCE"), (0, 1, "PREFERENCE_LIGHT"), (5, 5, "BASELINE")])
def test_signals(spark, a, p, label):
    assert one(spark, R.signal(F.lit(a + p), R.balance(F.lit(a), F.lit(p))))[0] == label


def test_decoders(spark):
    got = one(spark, R.bike_type(F.lit(2)), R.bike_type(F.lit(99)), R.phone_location(F.lit(0)), R.phone_location(F.lit(9)), R.incident_type(F.lit(-5)), R.incident_type(F.lit(77)), R.participant_type(F.lit(10)), R.participant_type(F.lit(0)))
    assert got == ("ROAD_RACING_BIKE", "NOT_CHOSEN", "POCKET", "OTHER", "DUMMY", "NOTHING", "SCOOTER", "OTHER")
    assert one(spark, R.closure_severity(F.lit("Vollsperrung")), R.closure_severity(F.lit(None).cast("string")), R.closure_factor(F.lit("Unfall")), R.closure_factor(F.lit("?"))) == ("FULL_CLOSURE", "UNKNOWN", "INCIDENT", "ROAD_CLOSURE")
    assert one(spark, R.cycleway_type(F.lit("Opposite_Lane")), R.cycleway_type(F.lit("odd")), R.cycleway_type(F.lit(None).cast("string"))) == ("LANE", "UNKNOWN", None)


def tags(spark, given):
    m = F.create_map(*(F.lit(x) for kv in given.items() for x in kv)) if given else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return spark.range(1).select(*(v.alias(k) for k, v in R.tag_columns(m).items())).first().asDict()


def test_tags(spark):
    t = tags(spark, {"cycleway:right": "track", "cycleway:left": "lane", "surface": "asphalt", "cycleway:right:width": "1.5", "oneway:bicycle": "-1"})
    assert (t["cycleway_type"], t["cycleway_location"], t["cycleway_surface"], t["cycleway_width"], t["bicycle_oneway"]) == ("TRACK", "RIGHT", "asphalt", 1.5, False)
    t = tags(spark, {"cycleway": "opposite_lane", "cycleway:surface": "sett", "cycleway:width": "wide"})
    assert (t["cycleway_type"], t["cycleway_location"], t["cycleway_surface"], t["cycleway_width"], t["bicycle_oneway"]) == ("LANE", "UNKNOWN", "sett", None, False)
    t = tags(spark, {"cycleway": "opposite", "oneway:bicycle": "yes", "surface": "x", "highway": "primary"})
    assert (t["cycleway_type"], t["cycleway_surface"], t["bicycle_oneway"], t["highway"]) == ("NO", None, True, "primary")
    t = tags(spark, {})
    assert t["cycleway_location"] == "NONE" and t["cycleway_type"] is None and t["bicycle_oneway"] is None


def haversine(a, b):
    p, q = map(math.radians, (a[1], b[1]))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * G.EARTH_M * math.asin(math.sqrt(h))


def test_distances(spark):
    a, b = (13.4, 52.5), (13.41, 52.51)
    near = one(spark, G.haversine(F.lit(a[1]), F.lit(a[0]), F.lit(b[1]), F.lit(b[0])), G.flat_metres(F.lit(a[1]), F.lit(a[0]), F.lit(b[1]), F.lit(b[0])))
    assert abs(near[0] - haversine(a, b)) < 1e-6 and abs(near[1] / near[0] - 1) < 2e-3
    road = line((13.0, 52.0), (13.01, 52.0))
    assert abs(one(spark, G.point_line_metres(F.lit(13.005), F.lit(52.0001), road))[0] - 11.132) < 1e-3
    assert abs(one(spark, G.point_line_degrees(F.lit(13.005), F.lit(52.0001), road))[0] - 0.0001) < 1e-9
    assert one(spark, G.line_line_metres(line((0, 0), (1, 1)), line((0, 1), (1, 0))))[0] == 0.0
    assert abs(one(spark, G.line_line_metres(line((13.0, 52.0), (13.001, 52.0)), line((13.0, 52.0005), (13.001, 52.0005))))[0] - 55.66) < 0.01


def test_bearings(spark):
    assert abs(one(spark, G.line_bearing(line((13.0, 52.0), (13.0, 52.1))))[0]) < 1e-9
    assert abs(one(spark, G.line_bearing(line((13.0, 52.0), (13.0, 52.0), (13.1, 52.0))))[0] - 90) < 0.1
    assert one(spark, G.line_bearing(line((13.0, 52.0))))[0] is None
    assert one(spark, G.compass(F.lit(-90.0)), G.turn(F.lit(350.0), F.lit(10.0))) == (270.0, 20.0)


def test_boxes(spark):
    meets = lambda *p: one(spark, G.meets_box(line(*p), 0.0, 0.0, 1.0, 1.0))[0]
    assert meets((-1, 0.5), (2, 0.5)) and meets((0.2, 0.2), (0.3, 0.3)) and meets((-1, 0), (0, 0)) and meets((0.5, -1), (0.5, 5))
    assert not meets((-1, 0.5), (0.5, 2.1)) and not meets((2, 2), (3, 3)) and not meets((-0.5, 0.8), (0.2, 1.6))
    west, south, east, north = G.grown_box(13.3, 52.4, 13.4, 52.5)
    assert abs((52.4 - south) * 111320 - 75) < 1e-6 and east - 13.4 > 52.4 - south and north > 52.5 and west < 13.3


def test_utm(spark):
    east, north = one(spark, *G.utm33(F.lit(15.0), F.lit(52.0)))
    assert abs(east - 500000) < 1e-6 and abs(north - 5761038.213) < 0.01
    east, north = one(spark, *G.utm33(F.lit(13.4050), F.lit(52.5200)))
    assert abs(east - 391779.3) < 0.5 and abs(north - 5820072.2) < 0.5


def sampled_overlap(shortest, actual, r, n=4000):
    kx, ky = math.cos(math.radians(shortest[0][1])) * G.M_PER_DEGREE, G.M_PER_DEGREE
    flat = lambda p: (p[0] * kx, p[1] * ky)

    def away(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        s = d[0] ** 2 + d[1] ** 2
        t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / s)) if s else 0
        return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])

    near = whole = 0.0
    for u, v in zip(shortest, shortest[1:]):
        u, v = flat(u), flat(v)
        size = math.hypot(v[0] - u[0], v[1] - u[1])
        hits = sum(any(away((u[0] + (v[0] - u[0]) * (i + 0.5) / n, u[1] + (v[1] - u[1]) * (i + 0.5) / n), flat(a), flat(b)) <= r for a, b in zip(actual, actual[1:])) for i in range(n))
        near, whole = near + size * hits / n, whole + size
    return near / whole


def test_overlap_ratio(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(12):
        walk = lambda n: [(13.4 + rng.uniform(0, 0.003), 52.5 + rng.uniform(0, 0.002)) for _ in range(n)]
        cases.append((walk(rng.randint(2, 4)), walk(rng.randint(2, 4))))
    df = spark.createDataFrame([([{"lon": x, "lat": y} for x, y in a], [{"lon": x, "lat": y} for x, y in b]) for a, b in cases], "s array<struct<lon:double,lat:double>>, a array<struct<lon:double,lat:double>>")
    got = [r[0] for r in df.select(G.overlap_ratio(F.col("s"), F.col("a"))).collect()]
    for g, (s, a) in zip(got, cases, strict=True):
        assert abs(g - sampled_overlap(s, a, 20.0)) < 2e-3
    same = line((13.4, 52.5), (13.41, 52.5))
    assert one(spark, G.overlap_ratio(same, same), G.overlap_ratio(line((1, 1), (1, 1)), same)) == (1.0, None)


def test_shapes(spark):
    joined = one(spark, G.stitch(F.array(line((0, 0), (1, 0)), line((1, 0), (2, 0)))))[0]
    assert [(p.lon, p.lat) for p in joined] == [(0, 0), (1, 0), (2, 0)]
    assert one(spark, G.gradient(F.lit(10.0), F.lit(15.0), F.lit(100.0)), G.gradient(F.lit(10.0), F.lit(15.0), F.lit(0.5)), G.gradient(F.lit(None).cast("double"), F.lit(1.0), F.lit(5.0))) == (5.0, 0.0, None)
    assert one(spark, G.line_text(line((13.5, 52.25), (1, 2))))[0] == "LINESTRING(13.5 52.25,1.0 2.0)"
    middle = one(spark, G.centroid(line((0, 0), (2, 0), (2, 2))))[0]
    assert (middle.lon, middle.lat) == (1.5, 0.5)


def test_parameters():
    assert FL.clamp(5000, 1, 1000) == 1000 and FL.clamp(0, 1, 5) == 1
    assert FL.parse_box("13.3,52.4,13.5,52.6") == (13.3, 52.4, 13.5, 52.6)
    for bad in ("1,2,3", "a,b,c,d", "2,1,1,3", "1,1,1,2"):
        with pytest.raises(ValueError):
            FL.parse_box(bad)
    with pytest.raises(ValueError):
        FL.check_range(2, 1)
    with pytest.raises(ValueError):
        EventFilter(event_type="ELSE")
    FL.check_range(None, 1)


def test_detectors_active(spark):
    active = lambda a, b, r: one(spark, FL.detector_active(F.lit("2024-05-05").cast("date"), F.lit(a).cast("date"), F.lit(b).cast("date"), F.lit(r).cast("boolean")))[0]
    assert active(None, None, None) and active("2024-05-05", "2024-05-05", False) and not active("2024-05-06", None, False) and not active(None, "2024-05-04", False) and not active(None, None, True)


@settings(max_examples=30, deadline=None)
@given(st.floats(-180, 180), st.floats(-180, 180))
def test_turn_is_symmetric(a, b):
    t = abs(((a - b + 540.0) % 360.0) - 180.0)
    assert 0 <= t <= 180
