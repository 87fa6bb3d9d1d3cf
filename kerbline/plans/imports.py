"""Queries of the sources and the import: texts as the sources write them are made from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import geo as G
from ..functions import rules as R
from ..operators import spatial
from ..sources import closures, ridefiles, traffic, weather
from ..streaming import overlap
from .adapters import Ride
from .catalog import c, longs, query


def _case(value: str, table: dict, default: str) -> str:
    quoted = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {value} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {quoted(default)} END"


# --- SRC-2..8, DF-11: ride files -----------------------------------------------------------------

# A file for each order: its lineitems as incidents, a dummy one for every eleventh supplier, and as points, some without a place.
_CODE = "CASE WHEN l_suppkey % 11 = 0 THEN -5 ELSE l_suppkey % 9 END"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag"


def _ride_files(r: Ride) -> DataFrame:
    # Rows are gathered as their few columns, and lines made of them afterwards, as a line is several times as long.
    columns = [*_ORDER.split(", "), "l_orderkey", "code"]
    rows = r.table("lineitem").withColumn("code", F.expr(_CODE))
    files = rows.groupBy(c("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))

    def incident(x):
        bits = [F.when(x["l_partkey"] % (i + 2) == 0, "1").otherwise("0") for i in range(10)]
        return F.concat_ws(",", text(x["l_linenumber"]), text(x["l_quantity"]), F.lit("13.4"), text(x["l_partkey"] * 1000), F.when(x["l_linenumber"] > 1, text(x["l_orderkey"] % 9)).otherwise(""), text((x["l_orderkey"] % 2)), F.lit("0"), text(x["l_orderkey"] % 8), text(x["code"]), *bits[:9], F.when(x["l_returnflag"] == "R", "1").otherwise("0"), F.lit('"a, b"'), bits[9])

    def point(x):
        located = x["l_linenumber"] % 4 != 0
        return F.concat_ws(",", F.when(located, text(x["l_discount"] + 52)).otherwise(""), F.when(located, text(x["l_tax"] + 13)).otherwise(""), F.lit("0.1,0.2,0.3"), text(x["l_suppkey"] * 1000), text(x["l_quantity"]))

    lines = F.concat(F.array(F.lit("app#1"), F.lit(",".join(ridefiles.INCIDENT_COLUMNS))), F.transform("rows", incident), F.array(F.lit(""), F.lit("=" * 25), F.lit("app#1"), F.lit("lat,lon,X,Y,Z,timeStamp,acc")), F.transform("rows", point))
    return files.select(F.concat(F.lit("VM2_"), c("key")).alias("file"), F.array_join(lines, "\r\n").alias("content"))


_SEQ = f"concat('VM2_', l_orderkey) AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS seq"


@query("src5_ride_points", f"SELECT {_SEQ}, CASE WHEN l_linenumber % 4 <> 0 THEN l_discount + 52 END AS lat, CASE WHEN l_linenumber % 4 <> 0 THEN l_tax + 13 END AS lon, l_suppkey * 1000 AS ts, l_quantity AS gps_accuracy FROM lineitem")
def _(r):
    return longs(ridefiles.points(ridefiles.sections(_ride_files(r))))


_NAMED = "concat_ws(',', " + ", ".join(f"CASE WHEN l_partkey % {i + 1} = 0 THEN '{name}' END" for i, name in D.PARTICIPANT_TYPE.items()) + ")"


@query("src6_ride_incidents", f"SELECT file, seq, ts, lat, incident_type, scary, description, participants FROM (SELECT {_SEQ}, l_partkey * 1000 AS ts, l_quantity AS lat, {_case(_CODE, D.INCIDENT_TYPE, 'NOTHING')} AS incident_type, {_CODE} AS code, l_returnflag = 'R' AS scary, 'a, b' AS description, {_NAMED} AS participants FROM lineitem) z WHERE code <> -5")
def _(r):
    found = ridefiles.incidents(ridefiles.sections(_ride_files(r)))
    return longs(found.select("file", "seq", "ts", "lat", "incident_type", "scary", "description", F.array_join("participants", ",").alias("participants")))


@query(
    "src7_ride_facts",
    f"""SELECT concat('VM2_', l_orderkey) AS file, arg_min(l_suppkey * 1000, ({_ORDER})) AS start_ms, arg_max(l_suppkey * 1000, ({_ORDER})) AS end_ms,
 CASE WHEN count(*) FILTER (WHERE l_linenumber % 4 <> 0) >= 2 THEN CAST(count(*) FILTER (WHERE l_linenumber % 4 <> 0) AS BIGINT) END AS vertices,
 CASE WHEN max(l_linenumber) > 1 THEN {_case("l_orderkey % 9", dict(enumerate(D.BIKE_TYPE)), "NOT_CHOSEN")} END AS bike_type,
 CASE WHEN max(l_linenumber) > 1 THEN l_orderkey % 2 = 1 END AS child_transport, CASE WHEN max(l_linenumber) > 1 THEN {_case("l_orderkey % 8", dict(enumerate(D.PHONE_LOCATION)), "OTHER")} END AS phone_location FROM lineitem GROUP BY l_orderkey""",
)
def _(r):
    facts = ridefiles.ride_facts(ridefiles.sections(_ride_files(r)))
    return facts.select("file", "start_ms", "end_ms", F.when(c("trajectory").isNotNull(), F.size("trajectory")).cast("long").alias("vertices"), "bike_type", "child_transport", "phone_location")


# --- SRC-9: weather answers ------------------------------------------------------------------------

@query("src9_weather_answers", "SELECT c_custkey / 10e0 AS lat2, c_nationkey / 10e0 AS lon2, 1719784800000 + h * 3600000 AS hour_ms, CASE WHEN h < 20 THEN c_nationkey + h * 0.5e0 END AS temperature_2m, CASE WHEN h % 5 <> 0 THEN CAST(h % 4 AS BIGINT) END AS weather_code FROM customer, (SELECT unnest(range(24)) AS h) t WHERE c_custkey % 9 <> 0")
def _(r):
    hours = F.sequence(F.lit(0), F.lit(23))
    time = F.transform(hours, lambda h: F.concat(F.lit("2024-07-01T"), F.lpad(h.cast("string"), 2, "0"), F.lit(":00")))
    warm = F.transform(F.filter(hours, lambda h: h < 20), lambda h: c("c_nationkey") + h * 0.5)
    code = F.transform(hours, lambda h: F.when(h % 5 != 0, h % 4))
    body = F.to_json(F.struct(F.struct(time.alias("time"), warm.alias("temperature_2m"), code.alias("weather_code")).alias("hourly")))
    # A customer is 24 rows and a text of more than a kilobyte, so a small file is dealt over all tasks before the texts are made.
    asked = r.table("customer").select("c_custkey", "c_nationkey").repartition(int(r.spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    answers = asked.select((c("c_custkey") / 10).alias("lat2"), (c("c_nationkey") / 10).alias("lon2"), F.when(c("c_custkey") % 9 == 0, "{broken").otherwise(body).alias("body"))
    return longs(weather.hourly(answers).select("lat2", "lon2", "hour_ms", "temperature_2m", "weather_code"))


# --- WN-3, DF-8, DF-9, SRC-17: revisions of closures ------------------------------------------------

# Five orders of a customer are revisions of about two occurrences of a closure.
_REVISION = """SELECT concat('k', CAST(o_custkey % 300 AS STRING)) AS id, o_orderkey AS place, o_orderkey % 3 AS occurrence,
 CASE o_orderkey % 7 WHEN 0 THEN 'Beendet' ELSE CASE o_orderkey % 5 WHEN 0 THEN 'Baustelle' WHEN 1 THEN 'Gefahr' WHEN 2 THEN 'Unfall' ELSE 'Sonstiges' END END AS subtype,
 CASE o_orderkey % 4 WHEN 0 THEN 'Vollsperrung' ELSE 'keine Sperrung' END AS severity, CASE o_orderkey % 6 WHEN 0 THEN 'Beendet' ELSE 'aktiv' END AS status, o_orderkey % 11 = 0 AS unstored, o_orderkey % 13 = 0 AS shapeless, CAST(o_orderkey AS BIGINT) AS n
FROM orders"""


def _revisions(r: Ride) -> DataFrame:
    made = r.spark.sql(_REVISION.replace("FROM orders", "FROM {o}"), o=r.table("orders"))
    day = lambda x: F.concat(F.lit("2024-0"), (c("occurrence") + x).cast("string"), F.lit("-05T10:30:00"))
    stored = F.date_format(F.timestamp_seconds(F.lit(1707000000) + c("n") % 5000 * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    point = F.struct(F.lit("Point").alias("type"), F.concat(F.lit("[13.4,"), (c("n") % 90).cast("string"), F.lit("]")).alias("coordinates"), F.lit(None).cast("array<struct<type:string,coordinates:string>>").alias("geometries"))
    validity = F.struct(day(1).alias("from"), day(5).alias("to"))
    return made.select("id", F.lit("f").alias("file"), "place", F.when(~c("unstored"), stored).alias("tstore"), "subtype", "severity", "status", validity.alias("validity"), F.lit("Nord").alias("direction"), F.lit("Weg").alias("street"), F.lit(None).cast("string").alias("content"), F.when(~c("shapeless"), point).alias("geometry"))


@query(
    "wn3_closure_revisions",
    f"""WITH rev AS (SELECT *, CASE WHEN NOT unstored THEN (1707000000 + n % 5000 * 3600) * 1000 END AS stored, (status = 'Beendet' OR subtype = 'Beendet') AS ended, CAST(epoch_ms(make_timestamp(2024, 1 + CAST(occurrence AS BIGINT), 5, 10, 30, 0) AT TIME ZONE 'Europe/Berlin') AS BIGINT) AS start_ms, CAST(epoch_ms(make_timestamp(2024, 5 + CAST(occurrence AS BIGINT), 5, 10, 30, 0) AT TIME ZONE 'Europe/Berlin') AS BIGINT) AS end_ms FROM ({_REVISION.replace("AS STRING", "AS VARCHAR")}) z WHERE NOT shapeless),
live AS (SELECT *, row_number() OVER (PARTITION BY id, occurrence ORDER BY coalesce(stored, -4611686018427387904) DESC, place DESC) AS k FROM rev WHERE NOT ended),
dead AS (SELECT *, row_number() OVER (PARTITION BY id, occurrence ORDER BY coalesce(stored, -4611686018427387904) DESC, place DESC) AS k FROM rev WHERE ended)
SELECT concat('historical:', l.id, ':', l.start_ms) AS feed_id, {_case("l.subtype", D.CLOSURE_FACTOR, "ROAD_CLOSURE")} AS factor_type, {_case("l.severity", D.CLOSURE_SEVERITY, "UNKNOWN")} AS severity, l.start_ms AS valid_from,
 CASE WHEN (coalesce(d.stored, -4611686018427387904) > coalesce(l.stored, -4611686018427387904) OR coalesce(d.stored, -4611686018427387904) = coalesce(l.stored, -4611686018427387904) AND d.place > l.place) AND d.stored >= l.start_ms THEN d.stored ELSE l.end_ms END AS valid_to, CAST(l.n % 90 AS DOUBLE) AS lat
FROM live l LEFT JOIN dead d ON d.id = l.id AND d.occurrence = l.occurrence AND d.k = 1 WHERE l.k = 1""",
)
def _(r):
    return closures.revisions(_revisions(r)).select("feed_id", "factor_type", "severity", "valid_from", "valid_to", "lat")


# --- WN-4: the nearest point of a ride --------------------------------------------------------------


@query(
    "wn4_nearest_points",
    """, places AS (SELECT DISTINCT l_orderkey AS ride_id, l_partkey AS edge_id, 52.5e0 + (l_suppkey % 400) * 0.0003e0 AS lat, 13.4e0 + (l_partkey % 300) * 0.0004e0 AS lon FROM lineitem WHERE l_linenumber <> 3),
one AS (SELECT ride_id, edge_id, min(lat) AS lat, min(lon) AS lon FROM places GROUP BY 1, 2)
SELECT o.ride_id, edge_id, arg_min(ts, (round(2 * 6371000e0 * asin(sqrt(least(1, power(sin(radians(p.lat - o.lat) / 2), 2) + cos(radians(o.lat)) * cos(radians(p.lat)) * power(sin(radians(p.lon - o.lon) / 2), 2)))), 6), seq)) AS ts FROM one o JOIN ride_points p ON p.ride_id = o.ride_id GROUP BY 1, 2""",
    ("ride_points",),
)
def _(r):
    rows = r.table("lineitem").where("l_linenumber <> 3").select(c("l_orderkey").alias("ride_id"), c("l_partkey").alias("edge_id"), (c("l_suppkey") % 400 * 0.0003 + 52.5).alias("lat"), (c("l_partkey") % 300 * 0.0004 + 13.4).alias("lon"))
    # Dealt by ride once, for the groups and for the join with the points.
    places = rows.repartition("ride_id").groupBy("ride_id", "edge_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return spatial.nearest_in_group(places, r.view("ride_points"), "ride_id", "edge_id", "ts", "seq")


# --- FL-9, JN-10: closures by time buckets, as the stream joins them ----------------------------------


@query(
    "jn10_closures_by_time",
    """, hours AS (SELECT DISTINCT segment_id, event_ts - event_ts % 3600000 AS h FROM segment_events),
hit AS (SELECT s.segment_id, k.* FROM closures k JOIN segments s ON s.lon1 IS NOT NULL AND abs(s.lat1 - k.lat) < 0.001 AND sqrt(power(greatest(0e0, greatest(s.lon1 - k.lon, k.lon - s.lon2)), 2) + power(s.lat1 - k.lat, 2)) <= 0.0003e0
  AND (street_name IS NULL OR trim(street_name) = '' OR lower(street_name) = 'unknown' OR trim(closure_street) = '' OR contains(lower(street_name), lower(closure_street)) OR contains(lower(closure_street), lower(street_name)))
  JOIN hours ON hours.segment_id = s.segment_id AND k.valid_from <= h + 3600000 AND (k.valid_to IS NULL OR k.valid_to >= h))
SELECT segment_id, factor_type, source, valid_from, min(feed_id) AS feed_id FROM hit GROUP BY segment_id, factor_type, source, valid_from""",
    ("segments", "segment_events", "closures"),
)
def _(r):
    return overlap.closures_on_stream(r.view("segment_events"), overlap.closure_buckets(r.segments(), r.closures())).select("segment_id", "factor_type", "source", "valid_from", "feed_id")


# --- SRC-10..12: traffic archives --------------------------------------------------------------------

# Lineitems as rows of each layout; the last row of a key, day and hour counts, and old speeds of -1 are missing.
_HOUR = "SELECT l_suppkey % 40 AS k, l_shipdate, CAST(l_linenumber AS BIGINT) AS hour, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS row_no, CAST(l_quantity AS BIGINT) AS volume, CASE WHEN l_partkey % 6 = 0 THEN -1e0 ELSE l_discount * 100 END AS speed, l_tax AS quality FROM lineitem WHERE l_partkey % 17 <> 0"


def _traffic(r: Ride, source: str, names: dict[str, str]) -> DataFrame:
    rows = r.spark.sql(_HOUR.replace("FROM lineitem", "FROM {l}"), l=r.table("lineitem"))
    # Of rows with equal numbers the one with the larger values counts, as in the SQL.
    last = rows.groupBy("k", F.to_date("l_shipdate").alias("day"), "hour", "row_no").agg(F.max(F.struct("volume", "speed", "quality")).alias("v")).select("k", "day", "hour", "row_no", "v.*")
    text = {"key": F.concat(F.lit(" D"), c("k").cast("string")), "day": F.date_format("day", "dd.MM.yyyy"), "hour": c("hour").cast("string"), "volume": c("volume").cast("string"), "speed": c("speed").cast("string"), "quality": c("quality").cast("string")}
    made = last.select(*(text[k].alias(n) for k, n in names.items()), text["key"].alias("file_key"), F.lit("f").alias("__file"), c("row_no").alias("__row"))
    return longs(traffic.measurements(made, source, F.lower("file_key")))


def _traffic_sql(source: str, key: str, speed: str, quality: str, completeness: str) -> str:
    return f"""SELECT '{source}' AS source_type, {key} AS key, day, hour, volume AS volume_kfz, {speed} AS speed_kfz, {quality} AS quality, {completeness} AS completeness FROM
 (SELECT *, CAST(l_shipdate AS DATE) AS day, row_number() OVER (PARTITION BY k, CAST(l_shipdate AS DATE), hour ORDER BY row_no DESC, volume DESC, speed DESC, quality DESC) AS n FROM ({_HOUR}) z) y WHERE n = 1"""


_TRAFFIC = ("source_type", "key", "day", "hour", "volume_kfz", "speed_kfz", "quality", "completeness")


@query("src10_old_detectors", _traffic_sql("OLD_DETECTOR", "concat('D', k)", "nullif(speed, -1e0)", "quality", "CAST(NULL AS DOUBLE)"))
def _(r):
    return _traffic(r, "OLD_DETECTOR", {"key": "detid_15", "day": "tag", "hour": "stunde", "volume": "q_kfz_det_hr", "speed": "v_kfz_det_hr", "quality": "qualitaet"}).select(*_TRAFFIC)


@query("src11_cross_sections", _traffic_sql("OLD_MQ", "concat('D', k)", "nullif(speed, -1e0)", "quality", "CAST(NULL AS DOUBLE)"))
def _(r):
    return _traffic(r, "OLD_MQ", {"key": "mq_name", "day": "tag", "hour": "stunde", "volume": "q_kfz_mq_hr", "speed": "v_kfz_mq_hr", "quality": "qualitaet"}).select(*_TRAFFIC)


@query("src12_new_detectors", _traffic_sql("NEW_DETECTOR", "concat('d', k)", "speed", "CAST(NULL AS DOUBLE)", "quality"))
def _(r):
    return _traffic(r, "NEW_DETECTOR", {"day": "datum (ortszeit)", "hour": "stunde des tages (ortszeit)", "volume": "qkfz", "speed": "vkfz", "quality": "datapoints_rel"}).select(*_TRAFFIC)


# --- SRC-15: detector master data ---------------------------------------------------------------------


@query(
    "src15_detectors",
    """SELECT concat('TE', s_suppkey) AS detector_key, CASE WHEN s_suppkey % 4 <> 0 THEN concat('10', s_suppkey) END AS det_id15, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey / 100e0 END AS lon, 52.5e0 AS lat,
 CASE s_suppkey % 3 WHEN 0 THEN DATE '2020-02-01' WHEN 1 THEN DATE '2021-03-04' END AS active_from, s_suppkey % 5 = 0 AS removed FROM supplier WHERE s_suppkey % 10 <> 9""",
)
def _(r):
    k = c("s_suppkey")
    cells = {"DET_NAME_ALT ": F.when(k % 10 == 9, " ").otherwise(F.concat(F.lit("TE"), k.cast("string"))), "DET_ID15": F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("10"), k.cast("string"), F.lit(".0"))), "LAENGE (WGS84)": F.when(k % 6 == 0, "nan").otherwise((k / 100).cast("string")), "BREITE (WGS84)": F.lit(" 52.5"), "Inbetriebnahme": F.when(k % 3 == 0, "01.02.2020").when(k % 3 == 1, "2021-03-04").otherwise("bald"), "DEINSTALLIERT": F.when(k % 5 == 0, "Ja").otherwise("nein")}
    found = traffic.detectors(r.table("supplier").select(*(v.alias(n) for n, v in cells.items())))
    return found.select("detector_key", "det_id15", "lon", "lat", "active_from", "removed")


# --- DF-10: tags of a way -------------------------------------------------------------------------------

_KIND = "CASE p_partkey % 6 WHEN 0 THEN 'track' WHEN 1 THEN 'no' WHEN 2 THEN 'lane' WHEN 3 THEN 'odd' WHEN 4 THEN 'opposite_lane' ELSE 'opposite' END"


@query(
    "df10_tag_columns",
    f"""SELECT p_partkey AS way_id, CASE WHEN side = 'NONE' THEN NULL ELSE {_case("kind", D.CYCLEWAY_TYPE, "UNKNOWN")} END AS cycleway_type, side AS cycleway_location,
 CASE WHEN side <> 'NONE' AND {_case("kind", D.CYCLEWAY_TYPE, "UNKNOWN")} <> 'NO' THEN coalesce(CASE WHEN p_size % 3 = 0 THEN 'paved' END, CASE WHEN p_size % 2 = 0 THEN 'asphalt' END) END AS cycleway_surface,
 CASE WHEN side <> 'NONE' AND {_case("kind", D.CYCLEWAY_TYPE, "UNKNOWN")} <> 'NO' AND p_size % 5 <> 0 THEN p_size / 10e0 END AS cycleway_width,
 CASE p_size % 7 WHEN 0 THEN true WHEN 1 THEN false ELSE CASE WHEN side = 'UNKNOWN' AND kind LIKE 'opposite%' THEN false END END AS bicycle_oneway
FROM (SELECT *, {_KIND} AS kind, CASE p_size % 5 WHEN 0 THEN 'BOTH' WHEN 1 THEN 'RIGHT' WHEN 2 THEN 'LEFT' WHEN 3 THEN 'UNKNOWN' ELSE 'NONE' END AS side FROM part) z""",
)
def _(r):
    kind = F.expr(_KIND)
    key = F.element_at(F.array(*map(F.lit, ("cycleway:both", "cycleway:right", "cycleway:left", "cycleway"))), (c("p_size") % 5 + 1).cast("int"))
    has = c("p_size") % 5 < 4
    pairs = F.array(
        F.when(has, F.struct(F.when(has, key).alias("k"), kind.alias("v"))),
        F.when(has & (c("p_size") % 3 == 0), F.struct(F.concat(F.when(has, key), F.lit(":surface")).alias("k"), F.lit("paved").alias("v"))),
        F.when(has, F.struct(F.concat(F.when(has, key), F.lit(":width")).alias("k"), F.when(c("p_size") % 5 == 0, "wide").otherwise((c("p_size") / 10).cast("string")).alias("v"))),
        F.when(c("p_size") % 2 == 0, F.struct(F.lit("surface").alias("k"), F.lit("asphalt").alias("v"))),
        F.when(c("p_size") % 7 < 2, F.struct(F.lit("oneway:bicycle").alias("k"), F.when(c("p_size") % 7 == 0, "yes").otherwise("no").alias("v"))),
    )
    tagged = r.table("part").select(c("p_partkey").alias("way_id"), F.map_from_entries(F.array_compact(pairs)).alias("tags"))
    return tagged.select("way_id", *(v.alias(n) for n, v in R.tag_columns(c("tags")).items() if n not in ("highway", "surface", "smoothness", "lit")))


# --- GE-2..6, GE-12: bearings, turns and lengths of edges -------------------------------------------------

_BEAR = "degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1))))"


@query(
    "ge3_edge_bearings",
    f"""SELECT edge_id, round({_BEAR}, 6) AS bearing, round(({_BEAR} + 360e0) % 360e0, 6) AS compass, round(abs(({_BEAR} - (edge_id % 360) + 540e0) % 360e0 - 180e0), 6) AS turn,
 round(sqrt(power((lat2 - lat1) * 111320e0, 2) + power((lon2 - lon1) * 111320e0 * cos(radians((lat1 + lat2) / 2)), 2)), 6) AS flat_metres FROM street_edges""",
    ("street_edges",),
)
def _(r):
    ends = [c("lat1"), c("lon1"), c("lat2"), c("lon2")]
    way = G.bearing(*ends)
    return r.view("street_edges").select("edge_id", F.round(way, 6).alias("bearing"), F.round(G.compass(way), 6).alias("compass"), F.round(G.turn(way, (c("edge_id") % 360).cast("double")), 6).alias("turn"), F.round(G.flat_metres(*ends), 6).alias("flat_metres"))
