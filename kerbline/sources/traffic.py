"""Traffic archives and detector master data in their several layouts."""

from __future__ import annotations

import os
import tarfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R

c = F.col
# The columns of each source; of several names the first one present counts.
LAYOUTS = {
    "NEW_DETECTOR": {"key": (), "day": ("datum", "datum (ortszeit)"), "hour": ("stunde", "stunde des tages (ortszeit)"), "volume_kfz": ("kfz", "qkfz"), "speed_kfz": ("vkfz",), "volume_pkw": ("qpkw",), "speed_pkw": ("vpkw",), "volume_lkw": ("qlkw",), "speed_lkw": ("vlkw",), "quality": (), "completeness": ("vollstaendigkeit", "datapoints_rel")},
    "OLD_DETECTOR": {"key": ("detid_15",), "day": ("tag",), "hour": ("stunde",), "volume_kfz": ("q_kfz_det_hr",), "speed_kfz": ("v_kfz_det_hr",), "volume_pkw": ("q_pkw_det_hr",), "speed_pkw": ("v_pkw_det_hr",), "volume_lkw": ("q_lkw_det_hr",), "speed_lkw": ("v_lkw_det_hr",), "quality": ("qualitaet",), "completeness": ()},
    "OLD_MQ": {"key": ("mq_name",), "day": ("tag",), "hour": ("stunde",), "volume_kfz": ("q_kfz_mq_hr",), "speed_kfz": ("v_kfz_mq_hr",), "volume_pkw": ("q_pkw_mq_hr",), "speed_pkw": ("v_pkw_mq_hr",), "volume_lkw": ("q_lkw_mq_hr",), "speed_lkw": ("v_lkw_mq_hr",), "quality": ("qualitaet",), "completeness": ()},
}
VALUES = ("volume_kfz", "speed_kfz", "volume_pkw", "speed_pkw", "volume_lkw", "speed_lkw", "quality", "completeness")
DETECTOR_COLUMNS = {"det_name_alt": "detector_key", "det_id15": "det_id15", "mq_kurzname": "mq_name", "strasse": "detector_street", "richtung": "direction", "laenge (wgs84)": "lon", "breite (wgs84)": "lat", "inbetriebnahme": "active_from", "abbaudatum": "active_to", "deinstalliert": "removed"}


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Semicolon files, gzipped or not, with lower-case trimmed headers and the file's name and row order."""
    raw = spark.read.csv(path, sep=";", header=True)
    named = raw.toDF(*(h.strip().lstrip("﻿").lower() for h in raw.columns))
    return named.withColumns({"__file": F.input_file_name(), "__row": F.monotonically_increasing_id()})


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    return next((c(f"`{n}`") for n in names if n in df.columns), F.lit(None).cast("string"))


def measurements(rows: DataFrame, source: str, key: Column | None = None) -> DataFrame:
    """source_type, key, day, hour and values; the last row of a key counts, rows without key, day or hour don't.

    key: for new detectors, whose files are named after them: the file's name by default.
    """
    layout = LAYOUTS[source]
    get = {k: _first(rows, names) for k, names in layout.items()}
    if source == "NEW_DETECTOR":
        get["key"] = key if key is not None else F.lower(F.regexp_extract("__file", r"([^/]+?)(?:\.csv)?(?:\.gz)?$", 1))
    number = {v: (R.tolerant_int(get[v]) if v.startswith("volume") else R.tolerant_double(get[v])) for v in VALUES}
    if source != "NEW_DETECTOR":
        number |= {v: R.not_minus_one(number[v]) for v in VALUES if v.startswith("speed")}
    made = rows.select(F.lit(source).alias("source_type"), F.trim(get["key"]).alias("key"), R.tolerant_date(get["day"]).alias("day"), R.tolerant_int(get["hour"]).alias("hour"), *(number[v].alias(v) for v in VALUES), "__file", "__row")
    usable = made.where((c("key") != "") & c("day").isNotNull() & c("hour").isNotNull())
    return usable.groupBy("source_type", "key", "day", "hour").agg(F.max_by(F.struct(*VALUES), F.struct("__file", "__row")).alias("m")).select("source_type", "key", "day", "hour", "m.*")


def available_months(found: DataFrame) -> DataFrame:
    """source_type and month for which there is any data; the lookup's statuses depend on it."""
    return found.select("source_type", F.date_format("day", "yyyy-MM").alias("month")).distinct()


def pick_archive(names: list[str], stem: str, month: str) -> str | None:
    """The month's archive, under its singular name or else its plural one."""
    return next((n for form in (stem, stem + "s") for n in names if n.startswith(f"{form}_{month}")), None)


def unpack_archive(path: str, into: str) -> list[str]:
    """Extracts a tar archive once, on the driver, into a folder that the cluster shares; returns the files.

    Members that would land outside the folder raise an error. A marker file shows a complete extraction.
    """
    marker = os.path.join(into, ".complete")
    if not os.path.exists(marker):
        os.makedirs(into, exist_ok=True)
        with tarfile.open(path) as tar:
            for member in tar.getmembers():
                target = os.path.realpath(os.path.join(into, member.name))
                if not target.startswith(os.path.realpath(into) + os.sep):
                    raise ValueError(f"{member.name} points outside the folder")
            tar.extractall(into, filter="data")
        open(marker, "w").close()
    return sorted(os.path.join(d, f) for d, _, files in os.walk(into) for f in files if not f.startswith("."))


def detectors(rows: DataFrame) -> DataFrame:
    """Detector master data from a table of its sheet's columns: the last row of a key counts, blank keys don't.

    Whole numbers written as decimals lose the fraction; dates may be dd.MM.yyyy or ISO.
    """
    named = rows.toDF(*(h.strip().lower() for h in rows.columns)).withColumn("__row", F.monotonically_increasing_id())
    text = lambda n: F.nullif(F.regexp_replace(F.trim(_first(named, (n,)).cast("string")), r"^(-?\d+)\.0$", "$1"), F.lit(""))
    got = {v: text(k) for k, v in DETECTOR_COLUMNS.items()}
    got |= {v: R.tolerant_double(got[v]) for v in ("lon", "lat")} | {v: R.tolerant_date(got[v]) for v in ("active_from", "active_to")}
    got["removed"] = F.coalesce(F.lower(got["removed"]).isin("ja", "true", "1", "x"), F.lit(False))
    last = Window.partitionBy("detector_key").orderBy(F.desc("__row"))
    made = named.select("__row", *(v.alias(k) for k, v in got.items())).where(c("detector_key").isNotNull())
    return made.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place", "__row")


def located_detectors(found: DataFrame, radius: float = 75.0) -> DataFrame:
    """Detectors with a place, and the radius in which they count."""
    return found.where(c("lon").isNotNull() & c("lat").isNotNull()).withColumn("radius", F.lit(radius))
