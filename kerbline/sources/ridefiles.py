"""Ride files: two CSV sections, incidents above and points below a line of equals signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R

c = F.col
SEPARATOR = "======"
# The columns of the two sections.
POINT_COLUMNS = "lat lon X Y Z timeStamp acc a b c obsClosePassEvent obsDistanceLeft1 obsDistanceLeft2 obsDistanceRight1 obsDistanceRight2 RC RX RY RZ XL YL ZL".split()
INCIDENT_COLUMNS = "key lat lon ts bike childCheckBox trailerCheckBox pLoc incident i1 i2 i3 i4 i5 i6 i7 i8 i9 scary desc i10".split()
POINT_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in POINT_COLUMNS])
INCIDENT_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in INCIDENT_COLUMNS])


def ride_paths(name: Column) -> Column:
    """Paths of ride files: below a folder with Rides in its name, a file name that starts with VM and not with a dot."""
    file = F.element_at(F.split(name, "/"), -1)
    return name.contains("Rides") & file.startswith("VM") & ~file.startswith(".")


def discover(spark: SparkSession, root: str, imported: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """file and content of ride files below a folder that aren't imported yet (column file), by name.

    A limit is a batch of an import run. Files without a byte are passed over by Spark's readers.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "VM*").load(root)
    found = read.select("path", c("content").cast("string").alias("content")).where(ride_paths(c("path")))
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if imported is not None:
        found = found.join(imported.select("file"), "file", "left_anti")
    return found.orderBy("file").limit(limit) if limit is not None else found


def sections(files: DataFrame) -> DataFrame:
    """file, above and below: the lines that aren't blank on either side of the first separator; all above without one.

    Rows of empty files have two empty arrays; see is_empty.
    """
    lines = F.filter(F.split(F.replace(c("content"), F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(x) != "")
    at = F.transform(c("lines"), lambda x: x.contains(SEPARATOR))
    split = files.select("file", lines.alias("lines")).withColumn("at", F.array_position(at, True).cast("int"))
    plain = lambda part: F.filter(part, lambda x: ~x.contains(SEPARATOR))
    above = F.when(c("at") > 0, F.slice("lines", F.lit(1), F.greatest(c("at") - 1, F.lit(0)))).otherwise(c("lines"))
    below = F.when(c("at") > 0, F.slice("lines", c("at") + 1, F.size("lines"))).otherwise(F.array().cast("array<string>"))
    return split.select("file", plain(above).alias("above"), plain(below).alias("below"))


def is_empty() -> Column:
    return (F.size("above") == 0) & (F.size("below") == 0)


def table_rows(parts: DataFrame, section: str, marker: str, names: list[str]) -> DataFrame:
    """file, seq and a text column for each known name, from the rows below the header that starts with marker.

    The header's own order of columns counts; short rows are filled up with empty fields by counting commas, quoted
    ones too. Without a header there are no rows.
    """
    starts = F.transform(c(section), lambda x: x.startswith(marker))
    at = F.array_position(starts, True).cast("int")
    # The header's place of each name differs between versions. Missing headers give no rows, as null arrays, without a filter, which would be pushed below the lines' splitting and repeat it.
    body = parts.select("file", F.element_at(c(section), F.when(at > 0, at)).alias("header"), F.when(at > 0, F.slice(c(section), at + 1, F.size(section))).alias("rows"))
    # Places are sought once for a file, not for each row.
    heads = F.transform(F.split("header", ","), lambda h: F.trim(h))
    place = lambda name: F.array_position("heads", name).cast("int").alias(name)
    placed = body.select("file", heads.alias("heads"), "rows").select("file", F.size("heads").alias("width"), F.struct(*map(place, names)).alias("places"), "rows")
    rows = placed.select("file", "width", "places", F.posexplode_outer("rows").alias("seq", "row")).where(c("row").isNotNull())
    commas = lambda s: F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    padded = F.concat("row", F.repeat(F.lit(","), F.greatest(c("width") - 1 - commas(c("row")), F.lit(0))))
    wide = ", ".join(f"f{i} string" for i in range(48))
    # Rows without quotes are split at their commas, and so are those whose quotes enclose whole fields, the commas within them masked. Only other rows need
    # the CSV parser. A lambda's variable holds the parsed row: named by a column, the parser would run again for each of its fields.
    parsed = F.transform(F.array(F.from_csv("row", wide, {"mode": "PERMISSIVE"})), lambda v: F.array(*(v[f"f{i}"] for i in range(48))))
    runs = F.split(F.concat(F.lit(","), "row", F.lit(",")), '"')
    torn = F.exists(F.transform(runs, lambda x, i: (i % 2 == 0) & ~(x.startswith(",") & x.endswith(","))), lambda x: x)
    odd = c("row").contains("\\") | c("row").contains("\0") | c("row").contains("\1") | c("row").contains("\r") | torn
    masked = F.array_join(F.transform(runs, lambda x, i: F.when(i % 2 == 1, F.translate(x, ",", "\1")).otherwise(x)), "")
    enclosed = F.transform(F.split(F.substring(masked, F.lit(2), F.length(masked) - 2), ","), lambda x: F.translate(x, "\1", ","))
    fields = F.when(~c("row").contains('"') & ~c("row").contains("\0"), F.split("row", ",")).when(odd, F.element_at(parsed, 1)).otherwise(enclosed)
    # Filters on the fields would be pushed below the parsing and repeat it for each field; they stay above a generator.
    values = rows.select("file", "seq", "places", padded.alias("row")).select("file", "seq", F.explode(F.array(F.struct("places", fields.alias("v")))).alias("x")).select("file", "seq", "x.places", "x.v")

    def field(name: str) -> Column:
        return F.when(c(f"places.{name}") > 0, F.nullif(F.trim(F.get("v", c(f"places.{name}") - 1)), F.lit("")))

    return values.select("file", "seq", *(field(n).alias(n) for n in names))


def points(parts: DataFrame) -> DataFrame:
    """file, seq (file order), lat, lon, ts, accuracy of all rows of the points' section."""
    raw = table_rows(parts, "below", "lat,", POINT_COLUMNS)
    return raw.select("file", "seq", R.tolerant_double(c("lat")).alias("lat"), R.tolerant_double(c("lon")).alias("lon"), c("timeStamp").try_cast("long").alias("ts"), R.tolerant_double(c("acc")).alias("gps_accuracy"))


def incident_rows(parts: DataFrame) -> DataFrame:
    return table_rows(parts, "above", "key,", INCIDENT_COLUMNS)


def incidents(parts: DataFrame) -> DataFrame:
    """Reported incidents with a type other than -5: place, time, type, participants in the order of their codes."""
    raw = incident_rows(parts)
    kind = c("incident").try_cast("int")
    both = c("lat").isNotNull() & c("lon").isNotNull()
    from ..functions.domains import PARTICIPANT_TYPE

    named = F.array_compact(F.array(*(F.when(c(f"i{i}").isin("1", "1.0", "true"), name) for i, name in PARTICIPANT_TYPE.items())))
    yes = lambda x: F.coalesce(x.isin("1", "1.0", "true"), F.lit(False))
    return raw.where(kind.isNotNull() & (kind != -5)).select(
        "file", "seq", F.when(both, R.tolerant_double(c("lat"))).alias("lat"), F.when(both, R.tolerant_double(c("lon"))).alias("lon"), c("ts").try_cast("long").alias("ts"), R.incident_type(kind).alias("incident_type"), yes(c("scary")).alias("scary"), c("desc").alias("description"), named.alias("participants")
    )


def ride_facts(parts: DataFrame) -> DataFrame:
    """A row for each file: bike and phone facts of its first incident row with a bike, times of the first and last point in file order, the trajectory of two located points or more."""
    yes = lambda x: x.isin("1", "1.0", "true")
    bike = incident_rows(parts).where(c("bike").isNotNull())
    facts = F.struct(R.bike_type(c("bike").try_cast("int")).alias("bike_type"), yes(c("childCheckBox")).alias("child_transport"), yes(c("trailerCheckBox")).alias("trailer_attached"), R.phone_location(c("pLoc").try_cast("int")).alias("phone_location"))
    known = bike.groupBy("file").agg(F.min_by(facts, "seq").alias("m")).select("file", "m.*")
    place = F.when(c("lat").isNotNull() & c("lon").isNotNull(), F.struct("seq", "lon", "lat"))
    line = F.transform(F.array_sort(F.collect_list(place)), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))
    rides = points(parts).groupBy("file").agg(F.min_by("ts", "seq").alias("start_ms"), F.max_by("ts", "seq").alias("end_ms"), line.alias("t"))
    located = rides.select("file", "start_ms", "end_ms", F.when(F.size("t") >= 2, c("t")).alias("trajectory"))
    return parts.where(~is_empty()).select("file").join(known, "file", "left").join(located, "file", "left")
