from pyspark.sql import functions as F

from kerbline.operators import enrich as E
from kerbline.plans import catalog
from kerbline.plans.adapters import Ride

LINE = "array<struct<lon:double,lat:double>>"


def test_asked_measurements_equal_a_table_of_all(spark):
    hour = 3_600_000
    segments = spark.createDataFrame([(s, "Weg", [{"lon": 13 + s * 0.1, "lat": 52.0}, {"lon": 13.001 + s * 0.1, "lat": 52.0}]) for s in range(4)], f"segment_id long, street_name string, line {LINE}")
    detectors = spark.createDataFrame([(f"TE{s}", f"D{s}", " " if s == 2 else f"MQ{s}", "Weg", "Ost", 13.0005 + s * 0.1, 52.0, None, None, False) for s in range(3)], "detector_key string, det_id15 string, mq_name string, detector_street string, direction string, lon double, lat double, active_from date, active_to date, removed boolean")
    events = spark.createDataFrame([(s * 10 + h, s, 1_717_200_000_000 + h * hour) for s in range(4) for h in range(6)] + [(99, 1, None)], "event_id long, segment_id long, event_ts long")
    days = E.best_detectors(events, segments, detectors)
    rows = [("NEW_DETECTOR", "TE0", 90.0, None, 2), ("NEW_DETECTOR", "TE0", 10.0, None, 3), ("OLD_DETECTOR", "D0", None, 1.0, 3), ("OLD_MQ", "MQ1", None, 0.1, 2), ("OLD_MQ", "MQ1", None, 0.9, 4)]
    day, hours = days.first()["day"], sorted({r.hour for r in days.collect()})
    table = spark.createDataFrame([(s, k, day, hours[h], 200, 40.0, quality, part) for s, k, part, quality, h in rows], "source_type string, key string, day date, hour int, volume_kfz int, speed_kfz double, quality double, completeness double")
    months = table.where("source_type <> 'OLD_DETECTOR'").select("source_type", F.date_format("day", "yyyy-MM").alias("month"))
    answer = lambda asked: asked.join(table.withColumn("measured", F.lit(True)), ["source_type", "key", "day", "hour"], "left")
    got = [sorted(map(str, E.enrich_traffic(events, segments, detectors, m, months).collect())) for m in (table, answer)]
    assert got[0] == got[1] and len(got[0]) == 25
    status = {r.event_id: r.traffic_status for r in E.enrich_traffic(events, segments, detectors, answer, months).collect()}
    assert [status[k] for k in (2, 3, 12, 14, 20, 30, 99)] == ["ENRICHED", "ENRICHED", "LOW_QUALITY", "ENRICHED", "NO_MEASUREMENT", "NO_DETECTOR_MATCH", "ERROR"]


def test_measurements_are_made_for_asked_keys_only(spark, sf_dir):
    answer, months = catalog._measurements(Ride(spark, sf_dir))
    asked = Ride(spark, sf_dir).table("lineitem").select(F.lit("OLD_DETECTOR").alias("source_type"), F.lit("D1").alias("key"), F.to_date("l_shipdate").alias("day"), F.lit(3).cast("long").alias("hour")).distinct()
    assert answer(asked).count() == asked.count()
    listed = spark.sql(catalog._MEASURE.replace("@lineitem", "{l}").replace("@supplier", "{s}"), l=Ride(spark, sf_dir).table("lineitem"), s=Ride(spark, sf_dir).table("supplier"))
    want = listed.where("key = 'D1' and hour = 3").select("day", "volume_kfz", "speed_kfz", "quality", "completeness")
    got = answer(asked).where("measured").select("day", "volume_kfz", "speed_kfz", "quality", "completeness")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert set(map(tuple, months.collect())) == set(map(tuple, listed.select("source_type", F.date_format("day", "yyyy-MM")).distinct().collect()))
