import json

import pytest
from pyspark.sql import functions as F

from kerbline.streaming import retry as R


def test_pauses():
    assert [R.pause_ms(n) // 60_000 for n in (1, 2, 3, 4, 5, 6, 7, 99)] == [1, 2, 4, 8, 16, 30, 30, 30]


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", R.STORE)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    if old:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def service(label, event_id, payload, now):
    """Refuses while the clock is below the payload's minute; a payload with `at` says until when."""
    if payload == "broken":
        raise ValueError("no answer")
    wish = json.loads(payload)
    if now < wish["from"] * 60_000:
        raise R.RateLimited(wish["at"] * 60_000 if "at" in wish else None)
    return f"answer {event_id}"


def test_pending_events_wait_for_the_clock(rocks, tmp_path):
    """A query for each file. The clock is the watermark: a file's rows see that of the file before, timers then that of their own."""
    spark, source, out = rocks, tmp_path / "in", []
    source.mkdir()
    plan = {
        1: [("a", 1, {"from": 0}), ("a", 2, {"from": 4}), ("a", 3, {"from": 0}), ("b", 10, {"from": 0, "at": 0}), ("b", 11, {"from": 6, "at": 8})],
        3: [("a", 4, "broken")],
        7: [("b", 12, {"from": 0})],
        9: [("a", 5, {"from": 5})],
    }

    def work(batch, number):
        out.extend((r.label, r.event_id, r.status, r.answer, r.at_ms // 60_000) for r in batch.collect() if r.label != "tick")

    stream = spark.readStream.schema("label string, event_id long, payload string, minute long").json(str(source)).withColumn("at", F.timestamp_seconds(F.col("minute") * 60)).withWatermark("at", "0 seconds")
    made = R.with_retries(stream, service, "at")
    for minute, rows in plan.items():
        lines = [{"label": a, "event_id": e, "payload": p if isinstance(p, str) else json.dumps(p), "minute": minute} for a, e, p in rows]
        lines.append({"label": "tick", "event_id": minute, "payload": "broken", "minute": minute})
        (source / f"{minute:02}.json").write_text("\n".join(map(json.dumps, lines)))
        query = made.writeStream.foreachBatch(work).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    at = {(a, e): (s, x, m) for a, e, s, x, m in out}
    assert len(out) == len(at) == 8  # nothing is lost or done twice
    assert at["a", 1] == ("DONE", "answer 1", 0) and at["b", 10] == ("DONE", "answer 10", 0)
    # 2 is refused at 0, at 1 after a minute, at 3 after two more; the wait of four minutes ends at 7. What came after it waits too.
    assert at["a", 2] == ("DONE", "answer 2", 7) and at["a", 3] == ("DONE", "answer 3", 7) and at["a", 4] == ("ERROR", "no answer", 7)
    # The row of pauses has ended, so 5 is called at once.
    assert at["a", 5] == ("DONE", "answer 5", 7)
    # The service named minute 8 itself.
    assert at["b", 11] == ("DONE", "answer 11", 9) and at["b", 12] == ("DONE", "answer 12", 9)
