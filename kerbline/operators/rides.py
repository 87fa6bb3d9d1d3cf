"""From matched rides to segment events, counters and rides' classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.geo import bearing, compass, haversine, legs, line_line_metres, overlap_ratio, stitch
from .components import ready_to_checkpoint
from .filters import valid_position
from .matching import match_traversals, ride_rows
from .spatial import box_cells, nearest_in_group, same_cells

c = F.col
LEAST_METRES, REACH_METRES = 500.0, 20.0
# Half the side of the square in which a name is sought, and the name where none is.
NAME_DEGREES, NAMELESS = 0.0003, "Unknown"


def usable_points(points: DataFrame) -> DataFrame:
    return points.where(valid_position(c("lat"), c("lon"), c("ts")))


def ride_ends(points: DataFrame) -> DataFrame:
    """ride_id, the first and last located point by time and how many there are; ties keep the earlier row."""
    place = F.struct("lat", "lon", "ts")
    located = points.where(c("lat").isNotNull() & c("lon").isNotNull() & c("ts").isNotNull())
    return located.groupBy("ride_id").agg(F.min_by(place, F.struct("ts", "seq")).alias("first"), F.max_by(place, F.struct(c("ts"), -c("seq"))).alias("last"), F.count("*").alias("located"))


def too_short(points: DataFrame, least: float = LEAST_METRES) -> DataFrame:
    """ride_id and skip: whether origin and destination are nearer than the least distance."""
    ends = ride_ends(usable_points(points))
    return ends.select("ride_id", (haversine(c("first.lat"), c("first.lon"), c("last.lat"), c("last.lon")) < least).alias("skip"))


def usage_counts(rides: DataFrame) -> DataFrame:
    """How often each edge was ridden; loops count each time."""
    return rides.select(F.explode("edge_ids").alias("segment_id")).groupBy("segment_id").agg(F.count("*").alias("usage_count"))


def event_counts(events: DataFrame) -> DataFrame:
    """Avoidances and preferences by segment, each ride once."""
    once = events.select("segment_id", "ride_id", "event_type").distinct()
    return once.groupBy("segment_id").agg(F.count_if(c("event_type") == "AVOIDANCE").alias("avoidance_count"), F.count_if(c("event_type") == "PREFERENCE").alias("preference_count"))


def with_counters(segments: DataFrame, rides: DataFrame, events: DataFrame) -> DataFrame:
    """segments with usage, avoidance and preference counts and the ratios that follow from them."""
    counts = segments.join(usage_counts(rides), "segment_id", "left").join(event_counts(events), "segment_id", "left").na.fill(0, ["usage_count", "avoidance_count", "preference_count"])
    return counts.withColumns({"avoidance_ratio": R.avoidance_ratio(c("usage_count"), c("avoidance_count")), "preference_ratio": R.preference_ratio(c("usage_count"), c("preference_count"))})


def middle_vertex(line):
    return F.element_at(line, F.floor(F.size(line) / 2).cast("int") + 1)


def named_edges(wanted: DataFrame, edges: DataFrame, degrees: float = NAME_DEGREES) -> DataFrame:
    """wanted (edge_id, street_name, line, others) with blank names replaced by that of the nearest named edge of `edges`, else "Unknown".

    Edges count that have a leg whose box meets the square of `degrees` to each side around the blank edge's middle vertex. The
    nearest one's first vertex is the nearest to it, to the micrometre; ties go to the smallest edge_id. The search
    is a join on grid cells of both sides.
    """
    named = lambda name: F.coalesce(name.rlike(r"\S"), F.lit(False))
    r, cell = degrees, 4 * degrees
    blank = wanted.where(~named(c("street_name")) & (F.size("line") > 0)).select("edge_id", middle_vertex(c("line")).alias("m")).dropDuplicates(["edge_id"])
    asked = blank.select("edge_id", "m", F.explode(box_cells(c("m.lon") - r, c("m.lon") + r, c("m.lat") - r, c("m.lat") + r, cell, cell)).alias("cell"))
    each = edges.where(named(c("street_name"))).select(c("edge_id").alias("other"), c("street_name").alias("name"), F.element_at("line", 1).alias("start"), F.explode(legs(c("line"))).alias("leg"))
    ends = {f"{pick.__name__}_{k}": pick(c(f"leg.p.{k}"), c(f"leg.q.{k}")) for pick in (F.least, F.greatest) for k in ("lon", "lat")}
    boxes = each.select("other", "name", "start", *(v.alias(k) for k, v in ends.items()))
    there = boxes.withColumn("cell", F.explode(box_cells(c("least_lon"), c("greatest_lon"), c("least_lat"), c("greatest_lat"), cell, cell)))
    meet = [c(f"least_{k}") <= c(f"m.{k}") + r for k in ("lon", "lat")] + [c(f"greatest_{k}") >= c(f"m.{k}") - r for k in ("lon", "lat")]
    near = same_cells(asked, there, "cell").where((c("edge_id") != c("other")) & meet[0] & meet[1] & meet[2] & meet[3])
    metres = F.round(haversine(c("m.lat"), c("m.lon"), c("start.lat"), c("start.lon")), 6)
    found = near.groupBy("edge_id").agg(F.min_by("name", F.struct(metres.alias("d"), c("other"))).alias("near_name"))
    name = F.when(named(c("street_name")), c("street_name")).otherwise(F.coalesce("near_name", F.lit(NAMELESS)))
    return wanted.join(found, "edge_id", "left").withColumn("street_name", name).drop("near_name")


def new_segments(segments: DataFrame, rides: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of rides that have no segment yet, as segments without counts; blank names come from the nearest named edge."""
    used = rides.select(F.explode(F.array_union("edge_ids", F.coalesce("path_edges", F.array().cast("array<bigint>")))).alias("edge_id")).distinct()
    fresh = used.join(segments.select(c("segment_id").alias("edge_id")), "edge_id", "left_anti")
    return named_edges(fresh.join(edges, "edge_id"), edges).select(c("edge_id").cast("long").alias("segment_id"), "street_name", "line", "gradient_percent")


def upsert_segments(segments: DataFrame, new: DataFrame) -> DataFrame:
    """Segments with those of `new` added; known ones take over a gradient."""
    fresh = new.select("segment_id", c("street_name").alias("n_name"), c("line").alias("n_line"), c("gradient_percent").alias("n_gradient"))
    return segments.join(fresh, "segment_id", "full_outer").select("segment_id", F.coalesce("street_name", "n_name").alias("street_name"), F.coalesce("line", "n_line").alias("line"), F.coalesce("n_gradient", "gradient_percent").alias("gradient_percent"), *(k for k in segments.columns if k not in ("segment_id", "street_name", "line", "gradient_percent")))


def edge_moments(rides: DataFrame, points: DataFrame, edges: DataFrame) -> DataFrame:
    """ride_id, edge_id, ts: the time of the point nearest to the middle vertex of each edge at its first ride; ties (to the micrometre) keep the point of the smaller seq."""
    first = rides.select("ride_id", F.explode(F.array_distinct("edge_ids")).alias("edge_id")).join(edges.select("edge_id", "line"), "edge_id")
    return _nearest_times(first.select("ride_id", "edge_id", middle_vertex(c("line")).alias("m")), points)


def _nearest_times(placed: DataFrame, points: DataFrame) -> DataFrame:
    return nearest_in_group(placed.select("ride_id", "edge_id", "m.lon", "m.lat"), usable_points(points), "ride_id", "edge_id", "ts", "seq")


def match_pending(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Rides matched to the road network: ride_id, status, actual_distance, edge_ids, trajectory and traversals.

    points: ride_id, seq, lat, lon, ts. edges: as match_rides takes them. Rides with fewer than two usable points
    and those that match no edge aren't returned, as they stay as they are. Rides with ends nearer than LEAST_METRES
    are SKIPPED without being matched, all others PENDING. Lines run as ridden: an edge is turned if its start and not
    its end is also an end of the next edge, the last one if its end and not its start is one of the edge before.
    traversals: edge_id, bearing (first to last vertex, null without length) and ts of the point nearest to the
    middle vertex, for each edge at its first ride, in order.
    """
    rides = ride_rows(usable_points(points), "seq").where(F.size("points") >= 2)
    first = F.array_min(F.transform("points", lambda p: F.struct(p["ts"], p["seq"], p["lat"].alias("lat"), p["lon"].alias("lon"))))
    last = F.array_max(F.transform("points", lambda p: F.struct(p["ts"], -p["seq"], p["lat"].alias("lat"), p["lon"].alias("lon"))))
    skip = haversine(first["lat"], first["lon"], last["lat"], last["lon"]) < LEAST_METRES
    matched = match_traversals(rides.where(c("ride_id").isNotNull() & ~skip), edges)
    as_ridden = F.transform("traversals", lambda x: F.struct(x["edge_id"].alias("edge_id"), x["metres"].alias("metres"), F.when(x["turned"], F.reverse(x["line"])).otherwise(x["line"]).alias("line"), x["once"].alias("once"), x["near"].alias("near")))
    ridden = matched.select("ride_id", as_ridden.alias("parts"))

    def traversal(x):
        p, q, m = F.element_at(x["line"], 1), F.element_at(x["line"], -1), middle_vertex(x["line"])
        way = F.when((p["lat"] != q["lat"]) | (p["lon"] != q["lon"]), compass(bearing(p["lat"], p["lon"], q["lat"], q["lon"])))
        nearest = F.array_min(F.transform(x["near"], lambda t: F.struct(F.round(haversine(m["lat"], m["lon"], t["lat"], t["lon"]), 6), t["seq"], t["ts"].alias("ts"))))
        return F.struct(x["edge_id"].alias("edge_id"), way.alias("bearing"), nearest["ts"].alias("ts"))

    done = ridden.select(
        "ride_id", F.lit("PENDING").alias("status"), F.aggregate("parts", F.lit(0.0), lambda sum_, x: sum_ + x["metres"]).alias("actual_distance"),
        F.transform("parts", lambda x: x["edge_id"]).alias("edge_ids"), stitch(F.transform("parts", lambda x: x["line"])).alias("trajectory"),
        F.transform(F.filter("parts", lambda x: x["once"]), traversal).alias("traversals"),
    )
    return done.unionByName(rides.where(skip).select("ride_id", F.lit("SKIPPED").alias("status")), allowMissingColumns=True)


def apart_edges(rides: DataFrame, edges: DataFrame, source: str, reference: str, way: str) -> DataFrame:
    """ride_id, edge_id: edges of `source` that aren't in `reference` and don't come near the line `way`.

    An edge that touches the line at an end counts as near, one without a line of its own as far.
    """
    only = rides.select("ride_id", F.col(way).alias("way"), F.explode(F.array_except(source, reference)).alias("edge_id"))
    placed = only.join(edges.select("edge_id", c("line").alias("own")).dropDuplicates(["edge_id"]), "edge_id", "left")
    near = F.coalesce(line_line_metres(c("own"), c("way")) <= REACH_METRES, F.lit(False))
    return placed.where(~near).select("ride_id", "edge_id")


def compare_rides(rides: DataFrame) -> DataFrame:
    """rides with overlap_ratio, route_comparison_type, is_detour, status and ride_intent.

    rides: ride_id, located, edge_ids, trajectory, actual_distance, shortest_distance, shortest_line and
    what ride_intent reads. Without two located points, edges, a trajectory or a shortest path a ride
    is SKIPPED; with metrics that can't be it is an ERROR.
    """
    lacking = (c("located") < 2) | F.coalesce(F.size("edge_ids") <= 0, F.lit(True)) | c("trajectory").isNull() | c("shortest_distance").isNull()
    overlap = rides.withColumn("overlap_ratio", overlap_ratio(c("shortest_line"), c("trajectory")))
    kind = overlap.withColumn("route_comparison_type", F.when(~lacking, R.route_comparison(c("actual_distance"), c("shortest_distance"), c("overlap_ratio"))))
    out = kind.withColumn("is_detour", c("route_comparison_type") != "EQUIVALENT_ROUTE").withColumn("status", F.when(lacking, "SKIPPED").when(c("route_comparison_type").isNull(), "ERROR").otherwise("PROCESSED"))
    names = ("start_ms", "end_ms", "actual_distance", "shortest_distance", "route_comparison_type", "is_detour", "overlap_ratio", "child_transport", "trailer_attached", "bike_type", "status")
    return out.withColumn("ride_intent", R.ride_intent({n: c(n) for n in names}))


def register_events(compared: DataFrame, edges: DataFrame, moments: DataFrame) -> DataFrame:
    """Events of local detours: an AVOIDANCE for each edge of the shortest path that was left out, a PREFERENCE for each one ridden instead.

    A ride with an event without a time yields none and is to be marked an ERROR (see failed_rides).
    """
    ready_to_checkpoint(compared.sparkSession)
    # Compared once: the overlap is costly, and a filter on what follows from it would repeat it.
    wanted = ["ride_id", "edge_ids", "path_edges", "trajectory", "shortest_line", "start_ms", "ride_intent", "route_comparison_type"]
    local = compared.select(*wanted).checkpoint().where(c("route_comparison_type") == "LOCAL_DETOUR")
    avoided = apart_edges(local, edges, "path_edges", "edge_ids", "trajectory").withColumn("event_type", F.lit("AVOIDANCE"))
    chosen = apart_edges(local, edges, "edge_ids", "path_edges", "shortest_line").withColumn("event_type", F.lit("PREFERENCE"))
    timed = avoided.unionByName(chosen).join(moments, ["ride_id", "edge_id"], "left").join(local.select("ride_id", "start_ms", "ride_intent"), "ride_id")
    events = timed.select(c("edge_id").cast("long").alias("segment_id"), "ride_id", "event_type", F.coalesce("ts", "start_ms").alias("event_ts"), "ride_intent")
    whole = events.withColumn("ok", F.bool_and(c("event_ts").isNotNull()).over(Window.partitionBy("ride_id")))
    return whole.select("*", R.day_of_week(c("event_ts")).alias("day_of_week"), R.hour_of_day(c("event_ts")).alias("hour_of_day"))


def failed_rides(events: DataFrame) -> DataFrame:
    return events.where(~c("ok")).select("ride_id").distinct()
