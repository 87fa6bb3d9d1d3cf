import json
import random

from pyspark.sql import functions as F

from kerbline.operators import enrich as E
from kerbline.operators import intervals as I
from kerbline.streaming import overlap as O

LINE = "array<struct<lon:double,lat:double>>"


def test_a_number_shares_one_bucket_with_its_intervals(spark):
    rnd = random.Random(1)
    edges = [0, 1, 15, 16, 17, 31, 255, 256, 257, 4095, 4096, I.MOST - 1, I.MOST, I.MOST + 1, -1, None]
    spans = [(a, b) for a in edges for b in edges] + [(a, a + rnd.randint(-2, 600)) for a in (rnd.randint(0, 5000) for _ in range(100))]
    rows = spark.createDataFrame([(k, *s) for k, s in enumerate(spans)], "k int, low long, high long").withColumn("b", I.interval_buckets(F.col("low"), F.col("high"))).collect()
    points = sorted({p for a, b in spans for x in (a, b) if x is not None for p in (x - 1, x, x + 1)} | {rnd.randint(0, 6000) for _ in range(200)})
    of = {r.p: {tuple(x) for x in r.b} for r in spark.createDataFrame([(p,) for p in points], "p long").withColumn("b", I.bucket_of(F.col("p"))).collect()}
    for r in rows:
        own = [tuple(x) for x in r.b]
        assert len(own) == len(set(own)) <= 2 * (I.BASE - 1) * I.LEVELS
        for p, buckets in of.items():
            inside = I.LEAST <= p <= I.MOST and (r.low is None or r.low <= p) and (r.high is None or p <= r.high)
            assert len(buckets.intersection(own)) == inside, (r.low, r.high, p)


def test_a_replayed_stream_equals_the_batch_rule(spark, tmp_path):
    rnd, hour = random.Random(2), 3_600_000
    segments = spark.createDataFrame([(s, rnd.choice(["Weg", "Gasse", None]), [{"lon": 13 + s * 0.01, "lat": 52.0}, {"lon": 13.001 + s * 0.01, "lat": 52.0}]) for s in range(5)], f"segment_id long, street_name string, line {LINE}")
    closures = []
    for k in range(120):
        start = 1_700_000_000_000 + rnd.randint(0, 200) * hour // 2
        end = rnd.choice([None, start, start - 2 * hour, start + rnd.randint(0, 3000) * hour // 3])
        closures.append((f"f{rnd.randint(0, 999)}", rnd.choice(["HAZARD", "EVENT"]), "VIZ", rnd.choice(["", "Weg", "Platz"]), start, end, 13.0005 + rnd.randint(0, 5) * 0.01, 52.0001))
    closures = spark.createDataFrame(closures, "feed_id string, factor_type string, source string, closure_street string, valid_from long, valid_to long, lon double, lat double")
    events = [{"event_id": k, "segment_id": rnd.randint(0, 6), "event_ts": 1_700_000_000_000 + rnd.randint(-50, 400) * hour // 3} for k in range(80)] + [{"event_id": 999, "segment_id": 1, "event_ts": None}]
    for k in range(4):
        (tmp_path / f"{k}.json").write_text("\n".join(map(json.dumps, events[k::4])))
    schema = "event_id long, segment_id long, event_ts long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    out: dict = {}

    def work(batch, number):
        out.update({(r.segment_id, r.factor_type, r.source, r.valid_from): (r.valid_to, r.feed_id) for r in batch.collect()})

    made = O.closures_on_stream(stream, O.closure_buckets(segments, closures))
    made.writeStream.foreachBatch(work).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    want = {(r.segment_id, r.factor_type, r.source, r.valid_from): (r.valid_to, r.feed_id) for r in E.closures_at(spark.read.schema(schema).json(str(tmp_path)), segments, closures).collect()}
    assert out == want and len(want) > 10
