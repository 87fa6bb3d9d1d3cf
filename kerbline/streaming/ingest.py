"""The batch import and enrichment as Structured Streaming jobs: a checkpoint takes the place of claims and name lists."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ridefiles
from .metrics import ImportMetrics, observed


def ride_stream(spark: SparkSession, root: str, files_per_batch: int = 500) -> DataFrame:
    """file and content of new ride files, in bounded batches."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "VM*").option("maxFilesPerTrigger", files_per_batch).load(root)
    found = raw.select("path", F.col("content").cast("string").alias("content")).where(ridefiles.ride_paths(F.col("path")))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def run_available(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Works off what there is, batch by batch, and stops; each batch is handed over once more only if it failed."""
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def import_rides(spark: SparkSession, root: str, out: str, checkpoint: str, files_per_batch: int = 500, metrics: ImportMetrics | None = None) -> StreamingQuery:
    """Writes rides, points and incidents of new files as Parquet, a folder for each batch, so a repeated batch replaces itself.

    metrics gets what the batches counted while they were written.
    """
    size = F.coalesce(F.size("trajectory"), F.lit(0))

    def work(batch: DataFrame, number: int) -> None:
        started = time.perf_counter()
        counted, files = observed(batch, files=F.count("*"))
        rides, rows = observed(ridefiles.ride_facts(ridefiles.sections(counted)), known=F.count("*"), without_points=F.count_if(F.col("start_ms").isNull() & F.col("end_ms").isNull() & (size == 0)), most_points=F.max(size))
        points, located = observed(ridefiles.points(ridefiles.sections(batch)), points=F.count("*"))
        incidents, reported = observed(ridefiles.incidents(ridefiles.sections(batch)), incidents=F.count("*"))
        for name, df in (("rides", rides), ("points", points), ("incidents", incidents)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        if metrics is not None:
            # A frame that is read several times in one plan counts its rows each time.
            n, known = batch.count() if files.get["files"] is None else files.get["files"], rows.get
            metrics.add(time.perf_counter() - started, files=n, empty=n - known["known"], without_points=known["without_points"], most_points=known["most_points"], points=located.get["points"], incidents=reported.get["incidents"])

    return run_available(ride_stream(spark, root, files_per_batch), checkpoint, work)


def enrich_events(events: DataFrame, enrich: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies an enrichment of the batch engine to a stream of events."""
    return run_available(events, checkpoint, lambda batch, number: enrich(batch).write.mode("overwrite").parquet(f"{out}/batch={number}"))


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by hour and type from a stream with a timestamp column at; rows later than the watermark are dropped by Spark."""
    return events.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("hour"), "event_type").agg(F.count("*").alias("n"))
