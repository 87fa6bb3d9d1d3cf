"""Analytical queries over events, segments, rides and incidents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions.geo import box, meets_box, point_line_metres
from ..functions.rules import ladder, normal_name, share, utc_year
from .filters import EventFilter, check_range, clamp, known_value
from .spatial import clusters, points_near_lines

c = F.col

# Bounds and labels of the bucket dimensions.
BUCKETS = {
    "TEMPERATURE_BUCKET": ("temperature_2m", [(0, "< 0 C"), (10, "0-10 C"), (20, "10-20 C"), (30, "20-30 C")], ">= 30 C"),
    "WIND_SPEED_BUCKET": ("wind_speed_10m", [(10, "< 10 km/h"), (25, "10-25 km/h"), (40, "25-40 km/h")], ">= 40 km/h"),
    "GRADIENT_BUCKET": ("gradient_percent", [(-3, "< -3%"), (0, "-3-0%"), (3, "0-3%")], ">= 3%"),
    "TRAFFIC_VOLUME_BUCKET": ("traffic_volume_kfz", [(150, "< 150"), (800, "150-800")], ">= 800"),
    "TRAFFIC_SPEED_BUCKET": ("traffic_speed_kfz", [(20, "< 20 km/h"), (30, "20-30 km/h"), (50, "30-50 km/h")], ">= 50 km/h"),
}
PLAIN = ("EVENT_TYPE", "HOUR_OF_DAY", "DAY_OF_WEEK", "RIDE_INTENT", "WIND_EXPOSURE", "CYCLEWAY_TYPE", "CYCLEWAY_LOCATION", "HIGHWAY", "SURFACE", "SMOOTHNESS", "LIT", "WEATHER_CODE", "TRAFFIC_CONDITION")
DIMENSIONS = (*PLAIN, "PRECIPITATION_BUCKET", *BUCKETS)
AVERAGES = ("temperature_2m", "precipitation", "wind_speed_10m", "traffic_volume_kfz", "traffic_speed_kfz", "avoidance_ratio", "preference_ratio")
#: Attributes that infrastructure signals can be drawn from.
ATTRIBUTES = ("CYCLEWAY_TYPE", "CYCLEWAY_LOCATION", "HIGHWAY", "SURFACE", "SMOOTHNESS", "LIT")


def avoided() -> Column:
    return c("event_type") == "AVOIDANCE"


def preferred() -> Column:
    return c("event_type") == "PREFERENCE"


#: Dimensions that were registered beside the fixed ones: the column that each name stands for.
_REGISTERED: dict[str, Callable[[], Column]] = {}


def register_dimension(name: str, value: Callable[[], Column]) -> None:
    """Adds a dimension of events and their segments' columns to distribution(); a name can't be given twice."""
    if name in DIMENSIONS or name in _REGISTERED:
        raise ValueError(f"there is a dimension {name}")
    _REGISTERED[name] = value


def unregister_dimension(name: str) -> None:
    _REGISTERED.pop(name, None)


def dimensions() -> tuple[str, ...]:
    """All names that distribution() takes."""
    return (*DIMENSIONS, *_REGISTERED)


def dimension_value(dimension: str) -> Column:
    """The raw value of a dimension."""
    if dimension in _REGISTERED:
        return _REGISTERED[dimension]()
    if dimension == "PRECIPITATION_BUCKET":
        return F.when(c("precipitation") == 0, "0 mm").otherwise(ladder(c("precipitation"), [(1, "< 1 mm"), (5, "1-5 mm")], ">= 5 mm"))
    if dimension in BUCKETS:
        value, steps, last = BUCKETS[dimension]
        return ladder(c(value), steps, last)
    return c(dimension.lower())


def zero_filled(df: DataFrame, column: str, domain: Iterable[str]) -> DataFrame:
    """value and n for each value of a domain, in one pass: a count for each value, turned into rows."""
    counts = df.agg(*(F.count_if(c(column) == v).alias(v) for v in domain))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, domain)), F.array(*(c(v) for v in domain)))).alias("value", "n"))


def summary(rides: DataFrame, segments: DataFrame, events: DataFrame) -> DataFrame:
    """counter, value, n: rides by status and comparison, segments, events by type, events measured, first and last time."""
    part = lambda df, name, column, domain: zero_filled(df, column, domain).select(F.lit(name).alias("counter"), "value", "n")
    one = lambda df, **aggs: df.agg(*(a.cast("long").alias(k) for k, a in aggs.items())).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, aggs)), F.array(*(c(k) for k in aggs)))).alias("value", "n"))
    named = lambda df, name: df.select(F.lit(name).alias("counter"), "value", "n")
    return (
        part(rides, "ride_status", "status", D.STATUS)
        .unionByName(part(rides, "route_comparison", "route_comparison_type", D.ROUTE_COMPARISON))
        .unionByName(part(events, "event_type", "event_type", D.EVENT_TYPE))
        .unionByName(named(one(segments, total=F.count("*"), observed=F.count_if(c("usage_count") + c("avoidance_count") > 0)), "segments"))
        .unionByName(named(one(events, total=F.count("*"), measured=F.count_if(c("traffic_status") == "ENRICHED"), first=F.min("event_ts"), last=F.max("event_ts")), "events"))
    )


def pipeline_status(events: DataFrame) -> DataFrame:
    """source, value, n: events by each source's enrichment status."""
    parts = [zero_filled(events, f"{s}_state", D.ENRICHMENT_STATUS).select(F.lit(s).alias("source"), "value", "n") for s in ("weather", "ohsome", "closure", "traffic")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distribution(events: DataFrame, segments: DataFrame, dimension: str, criteria: EventFilter = EventFilter(), limit: int = 50) -> DataFrame:
    """Events by a dimension: counts, shares and averages, the largest groups first.

    Groups form on the raw value and are labelled afterwards, so a missing value and one that is
    called UNKNOWN stay two rows.
    """
    if dimension not in dimensions():
        raise ValueError(f"no dimension {dimension}")
    joined = criteria.apply(events).join(segments.select("segment_id", "gradient_percent", "avoidance_ratio", "preference_ratio"), "segment_id")
    groups = joined.groupBy(dimension_value(dimension).alias("raw")).agg(
        F.count("*").alias("total"), F.count_if(avoided()).alias("avoidance"), F.count_if(preferred()).alias("preference"), *(F.avg(a).alias(f"avg_{a}") for a in AVERAGES)
    )
    top = groups.orderBy(F.desc("total"), c("raw").cast("string")).limit(clamp(limit, 1, 200))
    return top.select(
        F.lit(dimension).alias("dimension"),
        F.coalesce(c("raw").cast("string"), F.lit("UNKNOWN")).alias("value"),
        "total",
        "avoidance",
        "preference",
        share(c("avoidance"), c("total")).alias("avoidance_share"),
        share(c("preference"), c("total")).alias("preference_share"),
        *(F.round(f"avg_{a}", 6).alias(f"avg_{a}") for a in AVERAGES),
    )


def context(events: DataFrame, criteria: EventFilter = EventFilter()) -> DataFrame:
    """One row: rides, events by type, first and last time."""
    check_range(criteria.start, criteria.end)
    return criteria.apply(events).agg(
        F.countDistinct("ride_id").alias("rides"), F.count("*").alias("events"), F.count_if(avoided()).alias("avoidance"), F.count_if(preferred()).alias("preference"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts")
    )


def infrastructure_signals(events: DataFrame, attribute: str, criteria: EventFilter = EventFilter(), least: int = 5, limit: int = 10) -> DataFrame:
    """An attribute's values by how much more avoidance they see than the baseline, in percentage points.

    Signals are distinct (ride, event type, value); the baseline are distinct (ride, event type) over
    all known values. Coverage is the share of events with a known value.
    """
    if attribute not in ATTRIBUTES:
        raise ValueError(f"{attribute} is no attribute")
    check_range(criteria.start, criteria.end)
    value = c(attribute.lower())
    scope = criteria.apply(events)
    known = scope.where(known_value(value, c("ohsome_enriched"))).select("ride_id", "event_type", F.lower(F.trim(value)).alias("value"))
    totals = scope.agg(F.count("*").alias("matching"), F.count_if(known_value(value, c("ohsome_enriched"))).alias("known"))
    base = known.select("ride_id", "event_type").distinct().agg(F.count_if(avoided()).alias("base_avoidance"), F.count_if(preferred()).alias("base_preference"))
    buckets = known.distinct().groupBy("value").agg(F.count_if(avoided()).alias("avoidance"), F.count_if(preferred()).alias("preference")).where(c("avoidance") + c("preference") >= max(1, least))
    rate = c("avoidance") / (c("avoidance") + c("preference"))
    picked = buckets.withColumn("avoidance_share", rate).orderBy(F.desc("avoidance_share"), F.desc(c("avoidance") + c("preference")), "value").limit(clamp(limit, 1, 50))
    whole = totals.crossJoin(base)  # one row by one row
    baseline = share(c("base_avoidance"), c("base_avoidance") + c("base_preference"))
    return (
        picked.crossJoin(F.broadcast(whole))  # one row
        .select("value", "avoidance", "preference", "avoidance_share", share(c("known"), c("matching")).alias("coverage"), baseline.alias("baseline"), ((c("avoidance_share") - baseline) * 100).alias("difference"))
        .orderBy(F.desc_nulls_last("difference"), F.desc(c("avoidance") + c("preference")), "value")
    )


def with_matching_events(segments: DataFrame, events: DataFrame, criteria: EventFilter) -> DataFrame:
    """Segments with at least one event that meets all criteria; all segments without criteria."""
    return segments.join(criteria.apply(events).select("segment_id"), "segment_id", "left_semi") if criteria.active else segments


def observed(least: int) -> Column:
    return c("usage_count") + c("avoidance_count") >= least


def suspicious(segments: DataFrame, events: DataFrame, criteria: EventFilter = EventFilter(), least: int = 5, ratio: float = 0.1, limit: int = 100) -> DataFrame:
    """The most avoided segments; those without a ratio are left out."""
    found = with_matching_events(segments, events, criteria).where(observed(least) & (c("avoidance_ratio") >= ratio))
    return found.orderBy(F.desc("avoidance_ratio"), "segment_id").limit(clamp(limit, 1, 10_000))


def map_segments(segments: DataFrame, events: DataFrame, criteria: EventFilter = EventFilter(), least: int = 5, avoidance: float = 0.1, preference: float = 0.1, limit: int = 1000, within: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Located segments avoided or preferred enough: the strongest first, or inside a box by id."""
    a, p = F.coalesce("avoidance_ratio", F.lit(0.0)), F.coalesce("preference_ratio", F.lit(0.0))
    found = with_matching_events(segments, events, criteria).where(c("line").isNotNull() & observed(least) & ((a >= avoidance) | (p >= preference)))
    if within is not None:
        west, south, east, north = within
        edges = box(c("line"))
        near = (edges["max_lon"] >= west) & (edges["min_lon"] <= east) & (edges["max_lat"] >= south) & (edges["min_lat"] <= north)
        found = found.where(near & meets_box(c("line"), west, south, east, north)).orderBy("segment_id")
    else:
        found = found.orderBy(F.desc(F.greatest(a, p)), F.desc(c("usage_count") + c("avoidance_count")), "segment_id")
    return found.limit(clamp(limit, 1, 10_000))


def segment_events(events: DataFrame, rides: DataFrame, segment_id: int, criteria: EventFilter = EventFilter(), limit: int = 100) -> DataFrame:
    """A segment's latest events with their ride's bike."""
    found = criteria.apply(events.where(c("segment_id") == segment_id))
    return found.join(rides.select("ride_id", "bike_type"), "ride_id").orderBy(F.desc("event_ts"), "event_id").limit(clamp(limit, 1, 1000))


def traffic_stats(events: DataFrame) -> DataFrame:
    """Event counts and mean traffic of each segment."""
    means = ("traffic_volume_kfz", "traffic_speed_kfz", "temperature_2m", "precipitation", "wind_speed_10m", "wind_direction_10m")
    return events.groupBy("segment_id").agg(F.count_if(avoided()).alias("avoidance"), F.count_if(preferred()).alias("preference"), *(F.round(F.avg(m), 6).alias(f"avg_{m}") for m in means), F.lit(None).cast("string").alias("dominant_traffic_condition"))


def incidents_near(incidents: DataFrame, segments: DataFrame, metres: float = 25.0) -> DataFrame:
    """Pairs of an incident and a segment near it."""
    return points_near_lines(incidents, segments.select("segment_id", "line"), metres)


def incident_breakdown(near: DataFrame) -> DataFrame:
    """For each segment the number of its incidents and its counted types, the most frequent first; ties by type."""
    typed = near.where(c("incident_type").isNotNull()).groupBy("segment_id", "incident_type").agg(F.count("*").alias("n"))
    kinds = typed.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct((-c("n")).alias("n"), c("incident_type").alias("type")))).alias("k"))
    listed = kinds.select("segment_id", F.transform("k", lambda x: F.struct(x["type"].alias("type"), (-x["n"]).alias("n"))).alias("types"))
    return near.groupBy("segment_id").agg(F.count("*").alias("incidents")).join(listed, "segment_id", "left")


def segment_summaries(segments: DataFrame, incidents: DataFrame, factors: DataFrame) -> DataFrame:
    """Segments with incidents near them and the number of factors, by two grouped joins."""
    kinds = incident_breakdown(incidents_near(incidents, segments))
    counted = factors.groupBy("segment_id").agg(F.count("*").alias("factors"))
    return segments.join(kinds, "segment_id", "left").join(counted, "segment_id", "left").withColumns({"incidents": F.coalesce("incidents", F.lit(0)), "factors": F.coalesce("factors", F.lit(0))})


def event_years(events: DataFrame, last_year: int, first_year: int = 2015) -> DataFrame:
    return events.select(utc_year(c("event_ts")).alias("year")).distinct().where(c("year").between(first_year, last_year))


def corridors(segments: DataFrame, events: DataFrame, incidents: DataFrame, rides: DataFrame, rank: str = "AVOIDANCE", least_rides: int = 5, limit: int = 8, start: int | None = None, end: int | None = None, intent: str | None = None) -> DataFrame:
    """Streets of one name whose segments lie within 75 m of each other, ranked by the rides that avoid or prefer them.

    Only segments with events in scope form corridors. Rides are counted by grouping on (corridor,
    ride) first, so nothing is expanded for distinct counts. Corridors are cut to the limit before
    incidents are joined. Ties go by name and then by the smallest segment.
    """
    check_range(start, end)
    if rank not in D.EVENT_TYPE:
        raise ValueError(rank)
    scope = EventFilter(start=start, end=end, ride_intent=intent).apply(events).select("segment_id", "ride_id", "event_type")
    name = normal_name(c("street_name"))
    usable = segments.where(c("line").isNotNull() & (F.trim("street_name") != "") & (name != "unknown")).join(scope.select("segment_id").distinct(), "segment_id", "left_semi").withColumn("norm", name)
    member = usable.join(clusters(usable, 75.0, "norm", "segment_id"), "segment_id")
    edges = box(c("line"))
    shape = member.groupBy("cluster").agg(
        F.min("street_name").alias("street_name"), F.count("*").alias("segments"), F.array_sort(F.collect_list("segment_id")).alias("segment_ids"), *(getattr(F, k[:3])(e).alias(k) for k, e in edges.items())
    )
    hit = scope.join(member.select("segment_id", "cluster"), "segment_id")
    by_ride = hit.groupBy("cluster", "ride_id").agg(F.count_if(avoided()).alias("a"), F.count_if(preferred()).alias("p"))
    counts = by_ride.groupBy("cluster").agg(F.count_if(c("a") > 0).alias("avoidance_rides"), F.count_if(c("p") > 0).alias("preference_rides"), F.sum("a").alias("avoidance_events"), F.sum("p").alias("preference_events"))
    by_segment = hit.where(c("event_type") == rank).groupBy("cluster", "segment_id").agg(F.count("*").alias("n"))
    top = by_segment.groupBy("cluster").agg(F.max_by("segment_id", F.struct("n", -c("segment_id"))).alias("top_segment"))
    ranked = "preference" if rank == "PREFERENCE" else "avoidance"
    order = [F.desc(f"{ranked}_rides"), F.desc(f"{ranked}_events"), c("street_name"), c("cluster")]
    best = shape.join(counts, "cluster").join(top, "cluster", "left").where(c(f"{ranked}_rides") >= max(1, least_rides)).orderBy(*order).limit(clamp(limit, 1, 50))
    scary = incidents.where("scary")
    for bound, keep in ((start, lambda b: c("ts") >= b), (end, lambda b: c("ts") <= b)):
        scary = scary.where(keep(bound)) if bound is not None else scary
    if intent is not None:
        scary = scary.join(rides.where(c("ride_intent") == intent).select("ride_id"), "ride_id", "left_semi")
    lines = member.join(best.select("cluster"), "cluster", "left_semi").select("cluster", "line")
    near = points_near_lines(scary.select("incident_id", "lon", "lat"), lines, 25.0).groupBy("cluster").agg(F.countDistinct("incident_id").alias("scary_incidents"))
    return best.join(near, "cluster", "left").withColumn("scary_incidents", F.coalesce("scary_incidents", F.lit(0))).orderBy(*order)


def corridor_geometry(edges: DataFrame, name: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """One row: ids and lines of a street's edges that meet the box grown by 75 m, by id."""
    from math import isfinite

    from ..functions.geo import grown_box

    if not all(map(isfinite, (west, south, east, north))) or not (west < east and south < north):
        raise ValueError("invalid bounds")
    if max(east - west, north - south) > 0.25:
        raise ValueError("bounds are too large")
    area = grown_box(west, south, east, north)
    found = edges.where((normal_name(c("street_name")) == F.lower(F.trim(F.lit(name)))) & meets_box(c("line"), *area)).dropDuplicates(["edge_id"])
    both = F.array_sort(F.collect_list(F.struct("edge_id", "line")))
    return found.agg(F.transform(both, lambda x: x["edge_id"]).alias("edge_ids"), F.transform(both, lambda x: x["line"]).alias("lines"))


def calibration_sample(rides: DataFrame, points: DataFrame, per_type: int = 100, start: int | None = None, end: int | None = None) -> DataFrame:
    """Up to per_type compared rides of each kind, in the order of the MD5 of their ids, with point statistics."""
    check_range(start, end)
    found = rides.where(c("route_comparison_type").isNotNull())
    for bound, keep in ((start, lambda b: c("start_ms") >= b), (end, lambda b: c("start_ms") <= b)):
        found = found.where(keep(bound)) if bound is not None else found
    order = Window.partitionBy("route_comparison_type").orderBy(F.md5(c("ride_id").cast("string")))
    picked = found.withColumn("place", F.row_number().over(order)).where(c("place") <= clamp(per_type, 1, 200))
    stats = points.join(picked.select("ride_id"), "ride_id", "left_semi").groupBy("ride_id").agg(F.median("gps_accuracy").alias("median_accuracy"), F.count("*").alias("points"))
    joined = picked.join(stats, "ride_id", "left")
    excess = c("actual_distance") - c("shortest_distance")
    return joined.select(
        "ride_id", "start_ms", "route_comparison_type", "actual_distance", "shortest_distance", excess.alias("excess_distance"), F.when(c("shortest_distance") > 0, excess / c("shortest_distance")).alias("excess_ratio"), "overlap_ratio", "median_accuracy", F.coalesce("points", F.lit(0)).alias("points")
    )


def next_rides(rides: DataFrame, limit: int = 500) -> DataFrame:
    """The rides to work on next: pending ones, the earliest first, those without a time last."""
    return rides.where(c("status") == "PENDING").orderBy(F.asc_nulls_last("start_ms"), "ride_id").limit(limit)


def distance_to(lon: Column, lat: Column) -> Column:
    return point_line_metres(lon, lat, c("line"))
