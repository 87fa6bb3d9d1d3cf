"""Ride-shaped views over the driver's tables, written once in a dialect that Spark and DuckDB share.

Every view is a projection of one table with deterministic arithmetic, so scans, filters and pruning reach the files.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R

STREET = "CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN 'Unknown' WHEN p_partkey % 3 = 0 THEN concat(' street ', CAST(CAST(floor(p_partkey / 10e0) AS BIGINT) AS STRING)) ELSE concat('Street ', CAST(CAST(floor(p_partkey / 10e0) AS BIGINT) AS STRING)) END"

VIEWS = {
    "segments": (
        "part",
        f"""SELECT p_partkey AS segment_id, {STREET} AS street_name,
 CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 13.30e0 + (p_partkey % 50) * 0.002e0 END AS lon1,
 52.45e0 + floor(p_partkey / 50e0) * 0.001e0 AS lat1,
 CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 13.30e0 + (p_partkey % 50) * 0.002e0 + 0.0015e0 END AS lon2,
 CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_size % 15 - 7) * 1e0 + 0.5e0 END AS gradient_percent,
 CAST(p_size * 3 - 3 AS BIGINT) AS usage_count, CAST((p_partkey % 11) * (p_size % 2) AS BIGINT) AS avoidance_count, CAST(p_partkey % 7 AS BIGINT) AS preference_count
FROM part""",
    ),
    "rides": (
        "orders",
        """SELECT o_orderkey AS ride_id, @ms(o_orderdate) + (o_orderkey % 24) * 3600000 AS start_ms,
 @ms(o_orderdate) + (o_orderkey % 24) * 3600000 + (o_orderkey % 97) * 61000 AS end_ms,
 CASE o_orderstatus WHEN 'F' THEN 'PROCESSED' WHEN 'O' THEN 'PENDING' ELSE 'SKIPPED' END AS status,
 o_totalprice / 25e0 AS actual_distance, CASE WHEN o_orderkey % 41 = 0 THEN 0e0 ELSE o_totalprice / (25e0 + o_custkey % 15) END AS shortest_distance,
 CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE (o_orderkey % 101) / 100e0 END AS overlap_ratio,
 CASE o_orderkey % 5 WHEN 0 THEN 'ROAD_RACING_BIKE' WHEN 1 THEN 'CITY_TREKKING_BIKE' WHEN 2 THEN 'E_BIKE' WHEN 3 THEN NULL ELSE 'OTHER' END AS bike_type,
 CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS child_transport,
 CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS trailer_attached,
 CASE o_orderkey % 3 WHEN 0 THEN 'COMMUTE' WHEN 1 THEN 'LEISURE' ELSE 'UNKNOWN' END AS ride_intent
FROM orders""",
    ),
    "segment_events": (
        "lineitem",
        """SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS event_id, l_partkey AS segment_id, l_orderkey AS ride_id,
 CASE WHEN l_returnflag = 'R' THEN 'AVOIDANCE' ELSE 'PREFERENCE' END AS event_type,
 @ms(l_shipdate) + (l_orderkey % 24) * 3600000 AS event_ts,
 CASE l_orderkey % 3 WHEN 0 THEN 'COMMUTE' WHEN 1 THEN 'LEISURE' ELSE 'UNKNOWN' END AS ride_intent,
 l_linenumber % 2 = 0 AS traffic_enriched, l_quantity > 10e0 AS weather_enriched, l_quantity > 20e0 AS ohsome_enriched,
 CASE l_linenumber % 4 WHEN 0 THEN 'ENRICHED' WHEN 1 THEN 'NO_DETECTOR_MATCH' WHEN 2 THEN 'LOW_QUALITY' ELSE NULL END AS traffic_status,
 CASE l_linenumber % 6 WHEN 0 THEN NULL WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'LIGHT' WHEN 3 THEN 'MODERATE' WHEN 4 THEN 'HEAVY' ELSE 'CONGESTED' END AS traffic_condition,
 CASE l_linenumber % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'DONE' ELSE 'ERROR' END AS weather_state,
 CASE l_orderkey % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PROCESSING' ELSE 'DONE' END AS ohsome_state,
 CASE l_partkey % 4 WHEN 0 THEN 'ERROR' ELSE 'DONE' END AS closure_state, 'DONE' AS traffic_state,
 CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity - 12e0 END AS temperature_2m,
 CASE WHEN l_linenumber = 2 THEN NULL ELSE round(l_discount * 100e0) - 1e0 END AS precipitation,
 l_quantity AS wind_speed_10m, (l_orderkey % 360) * 1e0 AS wind_direction_10m, CAST(l_quantity AS INT) % 4 AS weather_code,
 CASE l_linenumber % 4 WHEN 0 THEN 'HEADWIND' WHEN 1 THEN 'TAILWIND' WHEN 2 THEN 'CROSSWIND' ELSE NULL END AS wind_exposure,
 CASE l_suppkey % 4 WHEN 0 THEN 'TRACK' WHEN 1 THEN 'LANE' WHEN 2 THEN 'UNKNOWN' ELSE NULL END AS cycleway_type,
 CASE l_suppkey % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'RIGHT' ELSE 'BOTH' END AS cycleway_location,
 CASE l_partkey % 3 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary' ELSE ' ' END AS highway,
 CASE l_linestatus WHEN 'F' THEN ' Sett' ELSE CASE l_linenumber % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'asphalt' WHEN 2 THEN 'sett ' ELSE NULL END END AS surface,
 CASE l_partkey % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' ELSE NULL END AS smoothness, CASE l_partkey % 2 WHEN 0 THEN 'yes' ELSE 'no' END AS lit,
 CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_quantity * 25e0 AS INT) END AS traffic_volume_kfz,
 CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity * 1.3e0 END AS traffic_speed_kfz
FROM lineitem""",
    ),
    "ride_points": ("lineitem", "SELECT l_orderkey AS ride_id, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS seq, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_quantity END AS gps_accuracy, 52.5e0 + (l_partkey % 100) * 0.001e0 AS lat, 13.4e0 + (l_suppkey % 100) * 0.001e0 AS lon, @ms(l_shipdate) + l_linenumber * 1000 AS ts FROM lineitem"),
    "street_edges": (
        "part",
        """SELECT p_partkey * 2 AS edge_id, p_partkey AS from_node, p_partkey + 1 AS to_node, 102e0 AS metres,
 13.30e0 + (p_partkey % 50) * 0.0015e0 AS lon1, 52.45e0 + floor(p_partkey / 50e0) * 0.001e0 AS lat1, 13.30e0 + (p_partkey % 50 + 1) * 0.0015e0 AS lon2, 52.45e0 + floor(p_partkey / 50e0) * 0.001e0 AS lat2, p_partkey * 2 % 5 <> 0 AS backward
FROM part WHERE p_partkey % 50 <> 49
UNION ALL SELECT p_partkey * 2 + 1, p_partkey, p_partkey + 50, 112e0,
 13.30e0 + (p_partkey % 50) * 0.0015e0, 52.45e0 + floor(p_partkey / 50e0) * 0.001e0, 13.30e0 + (p_partkey % 50) * 0.0015e0, 52.45e0 + (floor(p_partkey / 50e0) + 1) * 0.001e0, (p_partkey * 2 + 1) % 5 <> 0
FROM part""",
    ),
    # A ride goes up a stair of streets or straight on, some against the order of their lines, its points in the middle of the edges with an error of up to 6 m.
    "ride_traces": (
        "lineitem",
        """SELECT l_orderkey AS ride_id, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS seq,
 52.45e0 + 0.001e0 * ((l_orderkey * 7) % 37 + CASE WHEN l_orderkey % 3 = 0 THEN 0e0 ELSE floor((l_linenumber - 1) / 2e0) + CASE l_linenumber % 2 WHEN 0 THEN 0.5e0 ELSE 0e0 END END) + (l_suppkey % 17 - 8) * 0.000006e0 AS lat,
 13.30e0 + 0.0015e0 * (l_orderkey % 40 + CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber - 0.5e0 ELSE floor((l_linenumber - 1) / 2e0) + CASE l_linenumber % 2 WHEN 0 THEN 1e0 ELSE 0.5e0 END END) + (l_partkey % 21 - 10) * 0.000004e0 AS lon,
 1700000000000 + CASE l_orderkey % 4 WHEN 1 THEN -l_linenumber ELSE l_linenumber END * 20000 AS ts
FROM lineitem""",
    ),
    "incidents": (
        "events",
        """SELECT event_id AS incident_id, event_id * 3 AS ride_id, event_type = 'error' AS scary,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE 13.30e0 + (event_id % 500) * 0.0002e0 END AS lon, 52.45e0 + (user_id % 400) * 0.0001e0 AS lat, @ms(ts) AS ts,
 CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CLOSE_PASS' WHEN 2 THEN 'NEAR_HOOK' ELSE 'DODGING' END AS incident_type
FROM events""",
    ),
    "factors": ("events", "SELECT event_id AS factor_id, event_id % 2000 + 1 AS segment_id, CASE event_id % 3 WHEN 0 THEN 'WEATHER' WHEN 1 THEN 'CONSTRUCTION' ELSE 'HAZARD' END AS factor_type, @ms(ts) AS valid_from, CASE WHEN event_id % 7 = 0 THEN NULL ELSE @ms(ts) + (user_id % 50) * 3600000 END AS valid_to FROM events"),
    "detectors": (
        "supplier",
        """SELECT concat('TE', CAST(s_suppkey AS STRING)) AS detector_key, concat('D', CAST(s_suppkey AS STRING)) AS det_id15, concat('MQ', CAST(s_suppkey AS STRING)) AS mq_name,
 concat('Street ', CAST(CAST(floor((s_suppkey * 7) / 10e0) AS BIGINT) AS STRING)) AS detector_street,
 CASE s_nationkey % 8 WHEN 0 THEN 'Nord' WHEN 1 THEN 'Ost' WHEN 2 THEN 'Süd' WHEN 3 THEN 'West' WHEN 4 THEN 'Nordost' ELSE 'Suedwest' END AS direction,
 CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 13.3007e0 + ((s_suppkey * 7) % 50) * 0.002e0 END AS lon, 52.4502e0 + floor((s_suppkey * 7) / 50e0) * 0.001e0 AS lat,
 CASE WHEN s_suppkey % 5 = 0 THEN DATE '1996-01-01' ELSE NULL END AS active_from, CASE WHEN s_suppkey % 7 = 0 THEN DATE '1997-01-01' ELSE NULL END AS active_to, s_suppkey % 13 = 0 AS removed
FROM supplier""",
    ),
    "closures": (
        "customer",
        """SELECT concat('c', CAST(c_custkey AS STRING)) AS feed_id, CASE c_nationkey % 4 WHEN 0 THEN 'CONSTRUCTION' WHEN 1 THEN 'ROAD_CLOSURE' ELSE 'HAZARD' END AS factor_type, 'VIZ' AS source,
 CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('Street ', CAST(CAST(floor((c_custkey % 2000) / 10e0) AS BIGINT) AS STRING)) END AS closure_street,
 694224000000 + (c_custkey % 300) * 864000000 AS valid_from, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 694224000000 + (c_custkey % 300) * 864000000 + 2592000000 END AS valid_to,
 13.3003e0 + (c_custkey % 50) * 0.002e0 AS lon, 52.4501e0 + floor((c_custkey % 2000) / 50e0) * 0.001e0 AS lat
FROM customer""",
    ),
}

def segment_line():
    """A segment's two vertices; null without a longitude."""
    return F.when(F.col("lon1").isNotNull(), F.array(F.struct(F.col("lon1").alias("lon"), F.col("lat1").alias("lat")), F.struct(F.col("lon2").alias("lon"), F.col("lat1").alias("lat"))))


def spark_text(name: str) -> str:
    table, sql = VIEWS[name]
    return sql.replace("@ms(", "unix_millis(").replace(f"FROM {table}", "FROM {source}")


def duck_text(name: str) -> str:
    return re.sub(r"@ms\((\w+)\)", r"(epoch_us(\1) // 1000)", VIEWS[name][1])


def ctes(*names: str) -> str:
    """WITH clauses for DuckDB."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({duck_text(n)})" for n in names)


class Ride:
    """The views over one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        zoned = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
        return df.withColumns({n: F.col(n).cast("timestamp") for n in zoned})

    def view(self, name: str) -> DataFrame:
        return self.spark.sql(spark_text(name), source=self.table(VIEWS[name][0]))

    def segments(self) -> DataFrame:
        made = self.view("segments").withColumn("line", segment_line())
        c = F.col
        return made.withColumns({"avoidance_ratio": R.avoidance_ratio(c("usage_count"), c("avoidance_count")), "preference_ratio": R.preference_ratio(c("usage_count"), c("preference_count"))})

    def street_edges(self) -> DataFrame:
        """A grid of streets, some of them one-way, as a network of edges."""
        end = lambda i: F.struct(F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat"))
        return self.view("street_edges").select("edge_id", "from_node", "to_node", "metres", F.lit(True).alias("forward"), "backward", F.array(end(1), end(2)).alias("line"))

    def events(self) -> DataFrame:
        made = self.view("segment_events")
        return made.withColumns({"day_of_week": R.day_of_week(F.col("event_ts")), "hour_of_day": R.hour_of_day(F.col("event_ts"))})

    def rides(self) -> DataFrame:
        made, c = self.view("rides"), F.col
        kind = R.route_comparison(c("actual_distance"), c("shortest_distance"), c("overlap_ratio"))
        return made.withColumn("route_comparison_type", kind).withColumn("is_detour", c("route_comparison_type") != "EQUIVALENT_ROUTE")

    def __getattr__(self, name: str):
        if name in VIEWS:
            return lambda: self.view(name)
        raise AttributeError(name)
