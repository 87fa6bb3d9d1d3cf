import json

from kerbline.operators import exports as X
from kerbline.streaming import rebuild as B

LINE = "array<struct<lon:double,lat:double>>"
SEGMENT = f"segment_id long, street_name string, usage_count long, avoidance_count long, preference_count long, avoidance_ratio double, preference_ratio double, gradient_percent double, line {LINE}"
EVENT = "segment_id long, event_type string, event_ts long, traffic_enriched boolean, weather_enriched boolean, ohsome_enriched boolean, traffic_status string"


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    out, source = tmp_path / "features", tmp_path / "changes"
    source.mkdir()
    line = [{"lon": 13.0, "lat": 52.0}, {"lon": 13.1, "lat": 52.0}]
    state = {"usage": 1}
    events = spark.createDataFrame([(s, "AVOIDANCE", 1_577_836_800_000, True, False, False, "ENRICHED") for s in range(40)], EVENT)

    def segments():
        return spark.createDataFrame([(s, "x", state["usage"], 1, 1, None, None, None, line) for s in range(40)], SEGMENT)

    def files():
        return {p.parent.name: p.name for p in out.glob("part=*/*.txt")}

    def features():
        return sorted(r.value for r in spark.read.text(str(out)).collect())

    B.write_parts(segments(), events, str(out), [2020], 8)
    whole = lambda: sorted(r.value for r in X.tile_features(segments(), events, [2020]).collect())
    before = files()
    assert features() == whole() and len(before) == 8
    state["usage"] = 5
    changes = spark.readStream.schema("segment_id long").json(str(source))
    (source / "1.json").write_text('{"segment_id": 3}\n{"segment_id": 3}\n{"segment_id": null}\n')
    B.rebuild_on_change(changes, lambda: (segments(), events), str(out), str(tmp_path / "c"), [2020], 8, once=True)
    after = files()
    changed = {k for k in before if after[k] != before[k]}
    assert len(changed) == 1 and set(after) == set(before)
    own = spark.range(40).select(B.part_of(B.c("id"), 8).alias("p"), "id").collect()
    part = next(r.p for r in own if r.id == 3)
    assert changed == {f"part={part}"}
    use = {p["id"]: p["usageCount"] for p in (json.loads(t)["properties"] for t in features())}
    assert all(use[r.id] == (5 if r.p == part else 1) for r in own) and len(use) == 40
    # Nothing new, nothing written.
    B.rebuild_on_change(changes, lambda: (segments(), events), str(out), str(tmp_path / "c"), [2020], 8, once=True)
    assert files() == after
