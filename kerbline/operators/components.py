"""Connected components of a large graph, and the folder of its checkpoints."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ready_to_checkpoint(spark: SparkSession) -> None:
    """Keeps the cluster's shared folder. Where none is set, one process alone may use a folder of its own; a cluster may not."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))


#: Links that one task contracts at once; more of them take rounds over all tasks.
FINISH = 50_000


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of links (v, u) of bounded number, by union and find."""
    parent: dict = {}

    def find(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    schema = None
    for batch in batches:
        schema = schema or batch.schema
        for v, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v, u = find(v), find(u)
            if v != u:
                parent[max(u, v)] = min(u, v)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([find(x) for x in nodes], schema.field(0).type)], names=["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """node and root (the smallest node of its component) for each node of a link, by alternating large and small stars.

    Every round turns each node's links to its larger neighbours towards its smallest neighbour and then
    links all of a node's smaller neighbours to the smallest one, until nothing changes; the number of
    rounds grows with the logarithm of the longest chain. Smallest neighbours are grouped minima, combined
    before the shuffle, and joined back, so that a node with very many links can be split over tasks.
    Up to FINISH links are contracted by one task instead. Nulls and links of a node with itself are ignored, repeated links count once; no links, no rows.
    """
    ready_to_checkpoint(links.sparkSession)

    def least_of(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")

    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).distinct().checkpoint()
    if edges.count() <= FINISH:
        kind = edges.schema["v"].dataType.simpleString()
        return edges.select("v", "u").coalesce(1).mapInArrow(_roots, f"node {kind}, root {kind}")
    state = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least_of(both).withColumn("m", F.least("u", "m")).where((F.col("v") > F.col("u")) & (F.col("m") < F.col("v"))).select(F.col("m").alias("v"), F.col("v").alias("u")).distinct()
        links_to = F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.when(F.col("v") != F.col("m"), F.struct(F.col("m").alias("v"), F.col("v").alias("u"))))
        edges = least_of(large).select(F.explode(F.array_compact(links_to)).alias("x")).select("x.v", "x.u").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
    raise RuntimeError("the components did not settle")
