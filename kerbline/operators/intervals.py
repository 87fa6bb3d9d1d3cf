"""Interval joins by time buckets: an equality key that follows the time, so neither a long stay nor a busy key brings all pairs together.

Whole numbers are put into a tree of buckets of BASE children. An interval is the union of a few whole buckets (at most
2 * (BASE - 1) at each of LEVELS levels), a number lies in one bucket of each level, and a number is in an interval exactly if they share one of these buckets, and then just one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE, LEVELS = 16, 7
#: Bounds of the numbers that have buckets; intervals are cut to them.
LEAST, MOST = 0, BASE**LEVELS - 1


def _bucket(level: Column, number: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), number.cast("long").alias("number"))


def bucket_of(number: Column) -> Column:
    """The buckets of a number, an array with one of each level; none beyond the bounds."""
    inside = number.between(LEAST, MOST)
    return F.when(inside, F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: _bucket(k, F.floor(number / F.pow(F.lit(float(BASE)), k))))).otherwise(F.array().cast("array<struct<level:int,number:bigint>>"))


def interval_buckets(low: Column, high: Column) -> Column:
    """The buckets that make up a closed interval; null bounds are open, an empty interval has none."""
    start, end = (F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce(x, F.lit(y)).cast("long"))) for x, y in ((low, LEAST), (high, MOST)))
    outside = (F.coalesce(low, F.lit(LEAST)) > MOST) | (F.coalesce(high, F.lit(MOST)) < LEAST)
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)

    def climb(acc, level):
        a, b = acc["a"], acc["b"]
        top = level == LEVELS - 1
        # The first and last whole bucket of the next level.
        inner = F.floor((a + BASE - 1) / BASE).cast("long"), (F.floor((b + 1) / BASE) - 1).cast("long")
        head = F.when(top | (inner[0] > inner[1]), run(a, b)).otherwise(run(a, inner[0] * BASE - 1))
        tail = F.when(top | (inner[0] > inner[1]), none).otherwise(run((inner[1] + 1) * BASE, b))
        more = F.transform(F.concat(head, tail), lambda x: _bucket(level, x))
        rest = ~top & (inner[0] <= inner[1])
        return F.struct(F.when(rest, inner[0]).otherwise(F.lit(1).cast("long")).alias("a"), F.when(rest, inner[1]).otherwise(F.lit(0).cast("long")).alias("b"), F.concat(acc["out"], more).alias("out"))

    zero = F.struct(start.alias("a"), F.when(outside, start - 1).otherwise(end).alias("b"), F.array().cast("array<struct<level:int,number:bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), zero, climb, lambda acc: acc["out"])
