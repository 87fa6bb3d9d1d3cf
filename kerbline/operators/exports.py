"""What leaves the engine: map features, calibration CSV, feature collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.geo import line_json

c = F.col
CALIBRATION = ("ride_id", "start_time", "route_comparison_type", "actual_distance_m", "shortest_distance_m", "excess_distance_m", "excess_ratio", "overlap_ratio", "median_gps_accuracy_m", "gps_point_count", "actual_route_wkt", "shortest_route_wkt", "review_label", "review_notes")


def tile_columns(segments: DataFrame, events: DataFrame, years: list[int]) -> DataFrame:
    """Located observed segments with enrichment counts, balance, signal, and both for each year; nulls where a year has no events."""
    flags = {"traffic_enriched_count": c("traffic_enriched"), "weather_enriched_count": c("weather_enriched"), "ohsome_enriched_count": c("ohsome_enriched"), "traffic_measured_count": c("traffic_status") == "ENRICHED"}
    year = R.utc_year(c("event_ts"))
    yearly = {f"{n}_{y}": (year == y) & (c("event_type") == t) for y in years for n, t in (("avoidance", "AVOIDANCE"), ("preference", "PREFERENCE"))}
    counted = events.groupBy("segment_id").agg(*(F.count_if(p).alias(k) for k, p in {**flags, **yearly}.items()))
    seen = segments.where(c("line").isNotNull() & (c("usage_count") + c("avoidance_count") >= 1))
    joined = seen.join(counted, "segment_id", "left").na.fill(0, [*flags, *yearly])
    total = c("avoidance_count") + c("preference_count")
    value = R.balance(c("avoidance_count"), c("preference_count"))
    by_year = []
    for y in years:
        a, p = c(f"avoidance_{y}"), c(f"preference_{y}")
        by_year += [F.nullif(a + p, F.lit(0)).alias(f"event_count_{y}"), F.when(a + p > 0, R.signal(a + p, R.balance(a, p))).alias(f"bucket_{y}")]
    return joined.select("segment_id", "street_name", "usage_count", "avoidance_count", "preference_count", "avoidance_ratio", "preference_ratio", (c("usage_count") + c("avoidance_count")).alias("observations"), "gradient_percent", total.alias("event_count"), value.alias("balance"), R.signal(total, value).alias("bucket"), *flags, *by_year, "line")


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p if p.isdigit() else p.capitalize() for p in rest) if not (rest and rest[-1].isdigit()) else head + "".join(p.capitalize() for p in rest[:-1]) + "_" + rest[-1]


# Property names that don't follow the columns' names.
PROPERTY = {"segment_id": "id", "observations": "totalObservationCount", "traffic_enriched_count": "trafficEnrichedEventCount", "weather_enriched_count": "weatherEnrichedEventCount", "ohsome_enriched_count": "ohsomeEnrichedEventCount", "traffic_measured_count": "trafficMeasuredEventCount"}


def feature(row: DataFrame, keep_nulls: bool = False) -> Column:
    """A GeoJSON feature as text from all columns but line; null properties are left out unless kept."""
    names = [k for k in row.columns if k != "line"]
    properties = F.struct(*(c(k).alias(PROPERTY.get(k, _camel(k))) for k in names))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), line_json(c("line")).alias("geometry"), properties.alias("properties")), {"ignoreNullFields": str(not keep_nulls).lower()})


def tile_features(segments: DataFrame, events: DataFrame, years: list[int]) -> DataFrame:
    """One feature a row, ready for write.text."""
    columns = tile_columns(segments, events, years)
    return columns.select(feature(columns).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    """Line-delimited GeoJSON, a file for each partition."""
    features.write.mode("overwrite").text(path)


def map_features(segments: DataFrame) -> DataFrame:
    """Features of located segments with ten properties, nulls kept."""
    picked = segments.where(c("line").isNotNull()).select("segment_id", "street_name", "usage_count", "avoidance_count", "preference_count", "avoidance_ratio", "preference_ratio", (c("usage_count") + c("avoidance_count")).alias("observations"), "gradient_percent", (c("avoidance_count") + c("preference_count")).alias("event_count"), "line")
    return picked.select("segment_id", feature(picked, keep_nulls=True).alias("feature"))


def calibration_rows(sample: DataFrame, actual: Column, shortest: Column) -> DataFrame:
    """The sample in the fourteen columns of the review sheet; nulls are empty, the two review columns blank."""
    values = ["ride_id", "start_ms", "route_comparison_type", "actual_distance", "shortest_distance", "excess_distance", "excess_ratio", "overlap_ratio", "median_accuracy", "points"]
    columns = [*(c(v).cast("string") for v in values), actual, shortest, F.lit(""), F.lit("")]
    return sample.select(*(F.coalesce(v, F.lit("")).alias(n) for v, n in zip(columns, CALIBRATION, strict=True)))


def write_calibration(rows: DataFrame, path: str) -> None:
    """CSV with a header and all fields quoted; a sample is small, so it is one file."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True, emptyValue="")
