"""Calls of rate-limited services on a stream, with pauses and retries in keyed state.

A pipeline (its label is the key) works off its pending events in the order of their arrival. When the service asks it to wait, the
events from that one on stay pending, and the pipeline pauses until the time that the service names or else for FIRST_PAUSE_MS,
doubled with each pause in a row up to LONGEST_PAUSE_MS; a timer wakes it. A batch without a pause ends the row. Any other failure
marks its event as an error. Pending events are rows of the state store, so they outlive the query, and are read one by one.
Calls of one service are sequential by nature; other pipelines are other keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The first pause and the longest one.
FIRST_PAUSE_MS, LONGEST_PAUSE_MS = 60_000, 30 * 60_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = T.StructType([T.StructField("label", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("at_ms", T.LongType())])
EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("payload", T.StringType())])


class RateLimited(Exception):
    """The service asks to wait, until retry_at_ms if it says so."""

    def __init__(self, retry_at_ms: int | None = None):
        super().__init__(retry_at_ms)
        self.retry_at_ms = retry_at_ms


def pause_ms(attempt: int) -> int:
    """The pause after so many rate limits in a row (from 1)."""
    return min(FIRST_PAUSE_MS << min(max(attempt, 1) - 1, 30), LONGEST_PAUSE_MS)


class Retrying(StatefulProcessor):
    """States of a label: pending events by number of arrival, the next number, rate limits in a row, the end of the pause."""

    def __init__(self, call: Callable[[str, int, str, int], str], event_time: bool):
        self.call, self.event_time = call, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = T.StructType([T.StructField("n", T.LongType())])
        self.handle = handle
        self.pending = handle.getMapState("pending", number, EVENT)
        self.place = handle.getValueState("place", number)
        self.limits = handle.getValueState("limits", number)
        self.until = handle.getValueState("until", number)

    @staticmethod
    def _of(state) -> int:
        return state.get()[0] if state.exists() else 0

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def _work_off(self, label: str, now: int) -> Iterator[Row]:
        first = None
        for n in sorted(k[0] for k in self.pending.keys()):
            event, payload = self.pending.getValue((n,))
            try:
                status, answer = "DONE", self.call(label, event, payload, now)
            except RateLimited as e:
                first = e
                break
            except Exception as e:  # noqa: BLE001  the event fails, the pipeline goes on
                status, answer = "ERROR", str(e)
            self.pending.removeKey((n,))
            yield Row(label=label, event_id=event, status=status, answer=answer, at_ms=now)
        if first is None:
            self.limits.clear()
            self.until.clear()
            return
        if first.retry_at_ms is not None:
            resume = first.retry_at_ms
        else:
            limits = self._of(self.limits) + 1
            self.limits.update((limits,))
            resume = now + pause_ms(limits)
        self.until.update((resume,))
        self.handle.registerTimer(resume)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self._of(self.place)
        for row in rows:
            self.pending.updateValue((n,), (row["event_id"], row["payload"]))
            n += 1
        self.place.update((n,))
        now = self._now(timerValues)
        if now >= self._of(self.until):
            yield from self._work_off(key[0], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self._now(timerValues)
        if self.until.exists() and now >= self._of(self.until):
            yield from self._work_off(key[0], now)

    def close(self) -> None:
        pass


def with_retries(events: DataFrame, call: Callable[[str, int, str, int], str], event_time: str | None = None) -> DataFrame:
    """label, event_id, status (DONE or ERROR), answer and at_ms (when it was settled) of a stream of events (label, event_id, payload).

    call(label, event_id, payload, now_ms) returns an answer or raises RateLimited. event_time: a watermarked column whose time is the clock, for
    replays; without it the clock is that of the machine. Events with a null label share a pipeline. The session's state store must be STORE.
    """
    wanted = events.select("label", "event_id", "payload", *([event_time] if event_time else []))
    return wanted.groupBy("label").transformWithState(statefulProcessor=Retrying(call, event_time is not None), outputStructType=OUT, outputMode="Append", timeMode="EventTime" if event_time else "ProcessingTime")
