"""The road network from OpenStreetMap XML: nodes and ways to edges with access and length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine

c = F.col
NODE = "_id long, _lat double, _lon double, tag array<struct<_k:string,_v:string>>"
WAY = "_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>"
# What closes a way to bicycles.
NO_HIGHWAYS = ("motorway", "motorway_link", "trunk", "trunk_link", "construction", "proposed", "steps")
CLOSED = ("no", "private")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path)
    return rows.select(c("_id").alias("node"), c("_lat").alias("lat"), c("_lon").alias("lon"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """way, nodes in order and tags as a map."""
    rows = spark.read.format("xml").option("rowTag", "way").schema(WAY).load(path)
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"])))
    return rows.select(c("_id").alias("way"), F.transform("nd", lambda n: n["_ref"]).alias("nodes"), tags.alias("tags"))


def bicycle_access(tags) -> dict:
    """forward and backward: whether a bicycle may ride along the way."""
    get = lambda k: F.try_element_at(tags, F.lit(k))
    road = get("highway").isNotNull() & ~get("highway").isin(*NO_HIGHWAYS)
    closed = F.when(get("bicycle").isNotNull(), get("bicycle").isin(*CLOSED)).otherwise(F.coalesce(get("access").isin(*CLOSED), F.lit(False)) | F.coalesce(get("vehicle").isin(*CLOSED), F.lit(False)))
    oneway = F.coalesce(get("oneway:bicycle"), get("oneway"), F.when(get("junction") == "roundabout", "yes"), F.lit("no"))
    usable = road & ~closed
    return {"forward": usable & (oneway != "-1"), "backward": usable & ~oneway.isin("yes", "true", "1")}


def edges(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """An edge for each pair of neighbouring nodes of a way: edge_id, ends, metres, street_name, access, line."""
    access = bicycle_access(c("tags"))
    usable = ways.select("way", "nodes", F.try_element_at("tags", F.lit("name")).alias("street_name"), *(v.alias(k) for k, v in access.items())).where(c("forward") | c("backward"))
    pairs = usable.select("way", "street_name", "forward", "backward", "nodes", F.posexplode("nodes").alias("i", "from_node")).where(c("i") < F.size("nodes") - 1).withColumn("to_node", F.element_at("nodes", c("i") + 2)).drop("nodes")
    at = lambda p: nodes.select(c("node").alias(f"{p}_node"), c("lat").alias(f"{p}_lat"), c("lon").alias(f"{p}_lon"))
    placed = pairs.join(at("from"), "from_node").join(at("to"), "to_node")
    line = F.array(F.struct(c("from_lon").alias("lon"), c("from_lat").alias("lat")), F.struct(c("to_lon").alias("lon"), c("to_lat").alias("lat")))
    made = placed.select("way", "i", "from_node", "to_node", haversine(c("from_lat"), c("from_lon"), c("to_lat"), c("to_lon")).alias("metres"), "street_name", "forward", "backward", line.alias("line"))
    # Numbers without gaps would need one task for all edges: a way's number and the place within it are enough.
    return made.withColumn("edge_id", c("way").cast("long") * 4096 + c("i"))
