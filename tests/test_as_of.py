import bisect
import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import enrich as E

LINE = "array<struct<lon:double,lat:double>>"


def test_halving(spark):
    rnd = random.Random(1)
    rows = [(sorted(rnd.randint(0, 30) for _ in range(n)), rnd.randint(-2, 33)) for n in [0, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100] for _ in range(12)] + [([1, 2], None), (None, 3)]
    df = spark.createDataFrame(rows, "starts array<int>, at int").withColumn("n", E.last_before(F.col("starts"), F.col("at")))
    for r in df.collect():
        want = bisect.bisect_right(r.starts, r.at) if r.starts is not None and r.at is not None else None
        assert r.n == want


@pytest.mark.parametrize("seed", [1, 2])
def test_many_versions(spark, seed):
    """Against each event's comparison with all versions; the join's rows follow the ways and not their versions."""
    rnd, ways, segments = random.Random(seed), [], []
    for s in range(6):
        x = 13.0 + s * 0.01
        segments.append((s, rnd.choice(["A", None]), [{"lon": x, "lat": 52.0}, {"lon": x + 0.001, "lat": 52.0}]))
        for w in range(3):
            at = sorted(rnd.sample(range(1000), rnd.randint(1, 60)))
            for i, start in enumerate(at):
                end = (at[i + 1] if i + 1 < len(at) else None) if rnd.random() > 0.2 else start + 1
                lat = 52.0 + rnd.choice([0.00002, 0.00005, 0.01])
                ways.append((s * 10 + w, start, end, [{"lon": x, "lat": lat}, {"lon": x + 0.001, "lat": lat}], {"name": rnd.choice("AB"), "surface": f"{s}-{w}-{i}"}))
    events = [(k, rnd.randint(0, 7), rnd.choice([None, *range(-5, 1005, 3)])) for k in range(300)]
    ev = spark.createDataFrame(events, "event_id long, segment_id long, event_ts long")
    sg = spark.createDataFrame(segments, f"segment_id long, street_name string, line {LINE}")
    wy = spark.createDataFrame(ways, f"way_id long, valid_from long, valid_to long, line {LINE}, tags map<string,string>").repartition(3)
    got = {r.event_id: r.surface for r in E.enrich_tags(ev, sg, wy).collect()}
    names = {s: n for s, n, _ in segments}
    for k, s, ts in events:
        ok = [(w[4]["name"] != names.get(s), w[0], w[4]["surface"]) for w in ways if w[0] // 10 == s and ts is not None and w[1] <= ts and (w[2] is None or ts < w[2]) and w[3][0]["lat"] < 52.001]
        assert got[k] == (min(ok)[2] if ok else None), k
    assert len(got) == 300 and any(got.values())
    assert E.way_histories(wy).count() == 18
