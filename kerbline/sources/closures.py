"""Road closures from a GeoJSON feed and from daily snapshots of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R

c = F.col
ENDED = "Beendet"
GEOMETRY = "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>"
SCHEMA = f"features array<struct<properties:struct<id:string,tstore:string,subtype:string,severity:string,validity:struct<`from`:string,`to`:string>,direction:string,street:string,content:string,status:string>,geometry:{GEOMETRY}>>"


def shapes(geometry: Column) -> dict[str, Column]:
    """lon, lat of the label (the first point, else the first coordinate) and lines, from a geometry whose coordinates are JSON text."""
    alone = F.struct(geometry["type"].alias("type"), geometry["coordinates"].alias("coordinates"))
    parts = F.when(geometry["type"] == "GeometryCollection", geometry["geometries"]).otherwise(F.array(alone))
    of = lambda kind: F.filter(parts, lambda g: g["type"] == kind)
    pair = lambda v: F.struct(v[0].alias("lon"), v[1].alias("lat"))
    line = lambda text: F.transform(F.from_json(text, "array<array<double>>"), pair)
    single = F.transform(of("LineString"), lambda g: line(g["coordinates"]))
    many = F.flatten(F.transform(of("MultiLineString"), lambda g: F.transform(F.from_json(g["coordinates"], "array<array<array<double>>>"), lambda x: F.transform(x, pair))))
    lines = F.concat(single, many)
    points = F.transform(of("Point"), lambda g: pair(F.from_json(g["coordinates"], "array<double>")))
    label = F.coalesce(F.get(points, 0), F.get(F.get(lines, 0), 0))
    return {"lon": label["lon"], "lat": label["lat"], "lines": lines}


def read(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", pattern: str | None = None) -> DataFrame:
    """file, place and the features' fields, a row for each feature."""
    reader = spark.read.schema(SCHEMA).option("multiLine", True).option("encoding", encoding)
    raw = (reader.option("pathGlobFilter", pattern) if pattern else reader).json(path)
    rows = raw.select(F.input_file_name().alias("file"), F.posexplode("features").alias("place", "f"))
    return rows.select("file", "place", "f.properties.*", c("f.geometry").alias("geometry"))


def _closure(feed_id: Column, valid_from: Column, valid_to: Column) -> list[Column]:
    shape = shapes(c("geometry"))
    return [feed_id.alias("feed_id"), c("subtype"), R.closure_factor(c("subtype")).alias("factor_type"), R.closure_severity(c("severity")).alias("severity"), c("direction"), c("street").alias("closure_street"), c("content"), valid_from.alias("valid_from"), valid_to.alias("valid_to"), *(v.alias(k) for k, v in shape.items())]


def live(rows: DataFrame) -> DataFrame:
    """Closures of the current feed with an id, a geometry and a start; the last of an id counts."""
    start, end = R.local_text_ms(c("validity.from")), R.local_text_ms(c("validity.to"))
    last = Window.partitionBy("id").orderBy(F.desc("file"), F.desc("place"))
    kept = rows.where(c("id").isNotNull() & c("geometry").isNotNull() & start.isNotNull()).withColumn("n", F.row_number().over(last)).where("n = 1")
    return kept.select(*_closure(c("id"), start, end))


def historical(spark: SparkSession, folder: str) -> DataFrame:
    """Closures of the daily snapshots."""
    return revisions(read(spark, folder, "ISO-8859-1", "incidents_viz_*.json"))


def revisions(rows: DataFrame) -> DataFrame:
    """One closure for each (id, start): its latest active revision, closed early by a later ended one.

    Revisions are ordered by their store time (missing ones first) and then by file and place. What only ever ended is dropped.
    """
    start = R.local_text_ms(c("validity.from"))
    stored = R.instant_ms(c("tstore"))
    ended = F.coalesce((c("status") == ENDED) | (c("subtype") == ENDED), F.lit(False))
    usable = rows.where(c("id").isNotNull() & c("geometry").isNotNull() & start.isNotNull())
    ranked = usable.select("*", start.alias("start"), stored.alias("stored"), ended.alias("ended"), F.struct(F.coalesce(stored, F.lit(-(2**62))).alias("s"), "file", "place").alias("revision"))
    whole = F.struct(*(k for k in ranked.columns if k not in ("id", "start", "revision")))
    best = ranked.groupBy("id", "start").agg(F.max_by(F.when(~c("ended"), whole), F.when(~c("ended"), c("revision"))).alias("a"), F.max(F.when(~c("ended"), c("revision"))).alias("at"), F.max_by(F.when(c("ended"), c("stored")), F.when(c("ended"), c("revision"))).alias("closed"), F.max(F.when(c("ended"), c("revision"))).alias("closed_at"))
    live_rows = best.where(c("a").isNotNull()).select("id", "start", "a.*", "at", "closed", "closed_at")
    early = (c("closed_at") > c("at")) & (c("closed") >= c("start"))
    end = F.when(early, c("closed")).otherwise(R.local_text_ms(c("validity.to")))
    return live_rows.select(*_closure(F.concat_ws(":", F.lit("historical"), "id", "start"), c("start"), end))


def upsert(known: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """Closures by feed id: new fields replace known ones, the time first seen stays."""
    fields = [k for k in new.columns if k != "feed_id"]
    n = new.select("feed_id", *(c(k).alias(f"n_{k}") for k in fields), F.lit(True).alias("fresh"))
    both = known.join(n, "feed_id", "full_outer")
    pick = [F.when(c("fresh"), c(f"n_{k}")).otherwise(c(k)).alias(k) for k in fields]
    return both.select("feed_id", *pick, F.coalesce("first_seen", F.lit(now_ms)).alias("first_seen"), F.when(c("fresh"), F.lit(now_ms)).otherwise(c("last_seen")).alias("last_seen"))


def current(closures: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    from ..operators.filters import overlaps_range

    return closures.where(overlaps_range(c("valid_from"), c("valid_to"), start, end))
