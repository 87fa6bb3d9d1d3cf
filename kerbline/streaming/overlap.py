"""Closures that a stream of events meets, by an interval join through time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.enrich import closure_pairs
from ..operators.intervals import bucket_of, interval_buckets
from ..operators.spatial import same_cells

c = F.col


def closure_buckets(segments: DataFrame, closures: DataFrame) -> DataFrame:
    """segment_id, factor_type, source, valid_from, valid_to, feed_id and bucket: closures near segments, a row for each bucket of hours in which they are valid.

    An event's hour meets a closure that starts up to its end and ends at its start or later.
    """
    pairs = closure_pairs(segments, closures).where(c("valid_to").isNull() | (c("valid_to") >= c("valid_from") - R.HOUR_MS))
    first, last = F.ceil((c("valid_from") - R.HOUR_MS) / R.HOUR_MS), F.floor(c("valid_to") / R.HOUR_MS)
    return pairs.select("segment_id", "factor_type", "source", "valid_from", "valid_to", "feed_id", F.explode(interval_buckets(first, last)).alias("bucket"))


def closures_on_stream(events: DataFrame, buckets: DataFrame) -> DataFrame:
    """The closure factors that events meet, as operators.enrich.closures_at gives them, from a stream of events (segment_id, event_ts) and closure_buckets.

    Rows are joined by segment and time bucket. The result is a running minimum: write it in update mode, a later row of a key replaces the earlier one.
    Events before 1970 or without a time meet none.
    """
    hours = events.select("segment_id", F.floor(c("event_ts") / R.HOUR_MS).cast("long").alias("hour")).select("segment_id", F.explode(bucket_of(c("hour"))).alias("bucket"))
    hit = same_cells(hours, buckets, ["segment_id", "bucket"])
    made = hit.groupBy("segment_id", "factor_type", "source", "valid_from").agg(F.min_by(F.struct("feed_id", "valid_to"), "feed_id").alias("f"))
    return made.select("segment_id", "factor_type", "source", "valid_from", c("f.valid_to").alias("valid_to"), c("f.feed_id").alias("feed_id"))
