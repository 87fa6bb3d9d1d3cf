"""Enrichment of events: weather by the hour, traffic detectors, closures, map tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.geo import M_PER_DEGREE, centroid, line_bearing, point_line_degrees, point_line_metres, turn
from .filters import detector_active, overlaps
from .spatial import CELL_RADII, line_cells, nearest_points, point_cells, points_near_lines, same_cells

c = F.col
DETECTOR_METRES, DETECTOR_COUNT, CLOSURE_DEGREES, TAG_METRES = 75.0, 25, 0.0003, 15.0


def weather_places(events: DataFrame, segments: DataFrame) -> DataFrame:
    """Events with the place (two decimals) and hour at which their weather is looked up."""
    middle = centroid(c("line"))
    places = segments.where(F.size("line") >= 2).select("segment_id", F.round(middle["lat"], 2).alias("lat2"), F.round(middle["lon"], 2).alias("lon2"), line_bearing(c("line")).alias("bearing"))
    return events.join(places, "segment_id", "left").withColumn("hour_ms", R.hour_floor(c("event_ts")))


def enrich_weather(events: DataFrame, segments: DataFrame, weather: DataFrame) -> DataFrame:
    """event_id, the hour's weather and the wind's exposure; all null where there is none, weather_enriched is true all the same."""
    columns = ["temperature_2m", "precipitation", "wind_speed_10m", "wind_direction_10m", "weather_code"]
    hours = weather.select("lat2", "lon2", "hour_ms", *columns).dropDuplicates(["lat2", "lon2", "hour_ms"])
    joined = weather_places(events.select("event_id", "segment_id", "event_ts"), segments).join(hours, ["lat2", "lon2", "hour_ms"], "left")
    return joined.select("event_id", *columns, R.wind_exposure(c("bearing"), c("wind_direction_10m")).alias("wind_exposure"), F.lit(True).alias("weather_enriched"))


def weather_factors(events: DataFrame, segments: DataFrame, weather: DataFrame, existing: DataFrame) -> DataFrame:
    """The weather factors that events' hours add: a row for each new (segment, hour), valid for an hour."""
    wanted = weather_places(events.select("event_id", "segment_id", "event_ts"), segments).select("segment_id", "lat2", "lon2", "hour_ms").distinct()
    known = existing.where(c("factor_type") == "WEATHER").select("segment_id", c("valid_from").alias("hour_ms"))
    made = wanted.join(known, ["segment_id", "hour_ms"], "left_anti").join(weather.dropDuplicates(["lat2", "lon2", "hour_ms"]), ["lat2", "lon2", "hour_ms"])
    values = F.map_from_arrays(F.array(*map(F.lit, ("temperature_2m", "precipitation", "wind_speed_10m", "wind_direction_10m", "weather_code"))), F.array(*(c(k).cast("string") for k in ("temperature_2m", "precipitation", "wind_speed_10m", "wind_direction_10m", "weather_code"))))
    return made.select("segment_id", F.lit("WEATHER").alias("factor_type"), c("hour_ms").alias("valid_from"), (c("hour_ms") + R.HOUR_MS).alias("valid_to"), F.map_filter(values, lambda k, v: v.isNotNull()).alias("metadata"))


def best_detectors(events: DataFrame, segments: DataFrame, detectors: DataFrame) -> DataFrame:
    """event_id and the detector that fits its segment and local day best.

    The nearest DETECTOR_COUNT detectors of a segment are ranked before inactive ones are left out;
    the score's ties go to the nearer one.
    """
    near = nearest_points(detectors.where(c("lon").isNotNull()), segments.select("segment_id", "street_name", "line"), DETECTOR_METRES, DETECTOR_COUNT, "segment_id", "detector_key")
    scored = near.withColumn("score", R.detector_score(c("rank"), R.traffic_streets_match(c("street_name"), c("detector_street")), turn(line_bearing(c("line")), R.direction_degrees(c("direction")))))
    days = events.where(c("event_ts").isNotNull()).select("event_id", "segment_id", R.local_time(c("event_ts")).cast("date").alias("day"), R.hour_of_day(c("event_ts")).alias("hour"))
    active = days.join(scored, "segment_id").where(detector_active(c("day"), c("active_from"), c("active_to"), c("removed")))
    best = Window.partitionBy("event_id").orderBy(F.desc("score"), "rank")
    return active.withColumn("place", F.row_number().over(best)).where("place = 1").select("event_id", "day", "hour", "detector_key", "det_id15", "mq_name", "score")


def enrich_traffic(events: DataFrame, segments: DataFrame, detectors: DataFrame, measurements: DataFrame | Callable[[DataFrame], DataFrame], sources: DataFrame) -> DataFrame:
    """event_id, traffic_status and the first usable measurement: new detectors, then old ones, then cross-sections.

    sources: source_type and month for which data are available. measurements: source_type, key,
    day, hour and values, one row for each; or a function that adds the values and measured (true where there are any) to
    a frame with those four columns, so that a source needn't list all it could be asked.
    """
    kinds = {"NEW_DETECTOR": "detector_key", "OLD_DETECTOR": "det_id15", "OLD_MQ": "mq_name"}
    keys, values = ["source_type", "key", "day", "hour"], ["volume_kfz", "speed_kfz", "quality", "completeness"]
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("source_type"), c(k).alias("key")) for s, k in kinds.items())))
    asked = best_detectors(events, segments, detectors).select("event_id", "detector_key", "day", "hour", each.alias("x")).select("event_id", "detector_key", "day", "hour", "x.source_type", "x.key")
    answered = measurements(asked) if callable(measurements) else asked.join(measurements.select(*keys, *values, F.lit(True).alias("measured")), keys, "left")
    usable = R.measurement_usable(c("source_type"), c("volume_kfz"), c("speed_kfz"), c("quality"), c("completeness"))
    met = F.when(c("measured"), F.struct(usable.alias("usable"), "source_type", *values))
    months = sources.select("source_type", "month").distinct().withColumn("open", F.lit(True))
    joined = answered.select("event_id", "detector_key", "source_type", "key", met.alias("m"), F.date_format("day", "yyyy-MM").alias("month")).join(months, ["source_type", "month"], "left")
    there = F.bool_or(F.coalesce("open", F.lit(False)) & (F.coalesce(F.trim("key"), F.lit("")) != ""))
    of = {s: F.max(F.when(c("source_type") == s, c("m"))).alias(s) for s in kinds}
    by_event = joined.groupBy("event_id").agg(F.max("detector_key").alias("detector_key"), there.alias("there"), *of.values())
    first = F.coalesce(*(F.when(c(f"{s}.usable"), c(s)) for s in kinds))
    found = F.coalesce(*(c(s) for s in kinds)).isNotNull()
    status = F.when(first.isNotNull(), "ENRICHED").when(~c("there"), "NO_SOURCE_FILE").when(found, "LOW_QUALITY").otherwise("NO_MEASUREMENT")
    measured = by_event.select("event_id", "detector_key", status.alias("status"), first["source_type"].alias("source_type"), first["volume_kfz"].alias("volume_kfz"), first["speed_kfz"].alias("speed_kfz"))
    broken = c("segment_id").isNull() | c("event_ts").isNull()
    out = events.select("event_id", broken.alias("broken")).join(measured, "event_id", "left")
    return out.select(
        "event_id",
        F.when(c("broken"), "ERROR").otherwise(F.coalesce("status", F.lit("NO_DETECTOR_MATCH"))).alias("traffic_status"),
        "detector_key",
        "source_type",
        c("volume_kfz").alias("traffic_volume_kfz"),
        c("speed_kfz").alias("traffic_speed_kfz"),
        F.when(c("status") == "ENRICHED", R.traffic_condition(c("volume_kfz"), c("speed_kfz"))).alias("traffic_condition"),
        F.lit(True).alias("traffic_enriched"),
    )


def closure_pairs(segments: DataFrame, closures: DataFrame) -> DataFrame:
    """Closures with the segments that are near them in degrees and on a street of that name."""
    near = closures.where(c("valid_from").isNotNull() & c("lon").isNotNull())
    size = CLOSURE_DEGREES
    cell = CELL_RADII * size
    left = near.withColumn("__cell", F.explode(point_cells(c("lon"), c("lat"), cell, cell)))
    right = segments.where(F.size("line") >= 2).select("segment_id", "street_name", "line").withColumn("__cell", F.explode(line_cells(c("line"), cell, cell, size * M_PER_DEGREE)))
    return same_cells(left, right, "__cell").drop("__cell").where((point_line_degrees(c("lon"), c("lat"), c("line")) <= size) & R.closure_streets_match(c("street_name"), c("closure_street")))


def closures_at(events: DataFrame, segments: DataFrame, closures: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The closure factors that events meet: near in degrees, valid in the event's hour, on a street of that name.

    A row for each (segment, factor type, source, valid_from) that isn't among `existing`
    (segment, factor type, valid_from); of equal ones the smallest feed id stays.
    """
    pairs = closure_pairs(segments, closures)
    hours = events.select("segment_id", R.hour_floor(c("event_ts")).alias("hour_ms")).distinct()
    hit = pairs.join(hours, "segment_id").where(overlaps(c("valid_from"), c("valid_to"), c("hour_ms"), c("hour_ms") + R.HOUR_MS))
    made = hit.groupBy("segment_id", "factor_type", "source", "valid_from").agg(F.min_by(F.struct("feed_id", "valid_to"), "feed_id").alias("f")).select("segment_id", "factor_type", "source", "valid_from", c("f.valid_to").alias("valid_to"), c("f.feed_id").alias("feed_id"))
    return made if existing is None else made.join(existing.select("segment_id", "factor_type", "valid_from"), ["segment_id", "factor_type", "valid_from"], "left_anti")


def last_before(sorted_starts: Column, instant: Column) -> Column:
    """How many of the sorted numbers are at most the instant, by halving."""

    def halve(acc, _):
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        open_ = acc["low"] < acc["high"]
        there = F.try_element_at(sorted_starts, middle + 1) <= instant
        return F.struct(F.when(open_ & there, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~there, middle).otherwise(acc["high"]).alias("high"))

    size = F.size(sorted_starts)
    zero = F.struct(F.lit(0).alias("low"), size.alias("high"))
    return F.when(instant.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(size + 1.0)).cast("int")), zero, halve, lambda acc: acc["low"]))


def way_histories(ways: DataFrame) -> DataFrame:
    """way_id, starts (sorted) and versions (valid_to, line, tags) in the same order, a row for each way."""
    versions = F.array_sort(F.collect_list(F.struct("valid_from", F.coalesce("valid_to", F.lit(2**62)).alias("valid_to"), "line", F.map_entries("tags").alias("tags"))))
    made = ways.where(c("valid_from").isNotNull()).groupBy("way_id").agg(versions.alias("v"))
    return made.select("way_id", F.transform("v", lambda x: x["valid_from"]).alias("starts"), F.transform("v", lambda x: F.struct(x["valid_to"], x["line"], x["tags"])).alias("versions"))


def enrich_tags(events: DataFrame, segments: DataFrame, ways: DataFrame) -> DataFrame:
    """event_id and tag columns as of the event's instant, from the way near the segment's centre: one of its name, else the first.

    ways: way_id, valid_from, valid_to (exclusive, null: open), line, tags; versions of one way don't overlap. A segment is joined with the ways that were
    ever near it, each with its whole history; an event finds the version of its instant by halving and counts it if
    that version's line is near. So an event meets ways and not versions. Without a way all are null, and ohsome_enriched is true all the same.
    """
    middle = centroid(c("line"))
    centres = segments.where(F.size("line") >= 2).select("segment_id", "street_name", middle["lon"].alias("lon"), middle["lat"].alias("lat"))
    near = points_near_lines(centres, ways.select("way_id", "line").distinct(), TAG_METRES).select("segment_id", "street_name", "lon", "lat", "way_id").distinct()
    known = near.join(way_histories(ways), "way_id")
    close = F.transform("versions", lambda v: F.struct(v["valid_to"].alias("valid_to"), (point_line_metres(c("lon"), c("lat"), v["line"]) <= TAG_METRES).alias("near"), v["tags"].alias("tags")))
    held = known.select("segment_id", "street_name", "way_id", "starts", close.alias("versions"))
    at = events.select("event_id", "segment_id", "event_ts").join(held, "segment_id").withColumn("v", F.get("versions", last_before(c("starts"), c("event_ts")) - 1))
    valid = at.where((c("event_ts") < c("v.valid_to")) & c("v.near")).select("event_id", "street_name", "way_id", F.map_from_entries("v.tags").alias("tags"))
    same = F.coalesce(F.try_element_at("tags", F.lit("name")) == c("street_name"), F.lit(False))
    best = valid.groupBy("event_id").agg(F.min_by("tags", F.struct((~same).alias("other"), "way_id")).alias("tags"))
    out = events.select("event_id").join(best, "event_id", "left")
    return out.select("event_id", *(v.alias(k) for k, v in R.tag_columns(c("tags")).items()), F.lit(True).alias("ohsome_enriched"))


#: Providers by name: (events, segments) to a frame of event_id and the columns that they add.
_PROVIDERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register_provider(name: str, provide: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Adds a source of event columns; a name can't be given twice."""
    if name in _PROVIDERS:
        raise ValueError(f"there is a provider {name}")
    _PROVIDERS[name] = provide


def unregister_provider(name: str) -> None:
    _PROVIDERS.pop(name, None)


def provided(events: DataFrame, segments: DataFrame, names: list[str] | None = None) -> DataFrame:
    """events with the columns of the providers of those names, in that order (all by default); a later one's replace an earlier one's."""
    unknown = [n for n in names or () if n not in _PROVIDERS]
    if unknown:
        raise ValueError(f"no provider {unknown[0]}")
    for n in _PROVIDERS if names is None else names:
        events = marked(events, _PROVIDERS[n](events, segments))
    return events


def marked(events: DataFrame, result: DataFrame) -> DataFrame:
    """events with the result's columns instead of their own, by event_id."""
    new = [k for k in result.columns if k != "event_id"]
    return events.drop(*new).join(result, "event_id", "left")


def detector_pairs(detectors: DataFrame, segments: DataFrame) -> DataFrame:
    """Detectors near segments, ranked."""
    return nearest_points(detectors.where(c("lon").isNotNull()), segments.select("segment_id", "line"), DETECTOR_METRES, DETECTOR_COUNT, "segment_id", "detector_key")
