"""Map features kept up to date: a batch of changes rewrites only the partitions of the segments that it touched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.exports import feature, tile_columns

c = F.col
PARTS, CHECK = 64, "5 minutes"


def part_of(segment: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(segment.cast("long")), F.lit(parts)).cast("int")


def write_parts(segments: DataFrame, events: DataFrame, path: str, years: list[int], parts: int = PARTS, changed: DataFrame | None = None) -> None:
    """Line-delimited GeoJSON in a folder for each part (part=...): all of them, or those that hold a changed segment (segment_id).

    There are at most `parts` changed parts to join with, and both tables are read for their segments only. A part keeps its
    folder when its last feature goes.
    """
    mine, theirs = segments.withColumn("part", part_of(c("segment_id"), parts)), events.withColumn("part", part_of(c("segment_id"), parts))
    if changed is not None:
        touched = F.broadcast(changed.where("segment_id is not null").select(part_of(c("segment_id"), parts).alias("part")).distinct())
        mine, theirs = mine.join(touched, "part", "left_semi"), theirs.join(touched, "part", "left_semi")
    columns = tile_columns(mine.drop("part"), theirs.drop("part"), years)
    rows = columns.select(feature(columns).alias("value"), part_of(c("segment_id"), parts).alias("part"))
    mode = "dynamic" if changed is not None else "static"
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("part").text(path)


def rebuild_on_change(changes: DataFrame, load: Callable[[], tuple[DataFrame, DataFrame]], path: str, checkpoint: str, years: list[int], parts: int = PARTS, once: bool = False) -> StreamingQuery:
    """Rewrites what a stream of changes (segment_id) touched, at most once in CHECK and only if there are any.

    load gives segments and events as they are when a batch is handled; changes that come meanwhile are the next batch, so none is lost. once:
    works off what there is and stops.
    """

    def work(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write_parts(*load(), path, years, parts, batch)

    writer = changes.select("segment_id").writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=CHECK)).start()
    if once:
        query.awaitTermination()
    return query
