"""Hourly weather from API answers, and the road network's and tags' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R

c = F.col
FIELDS = {"temperature_2m": "double", "precipitation": "double", "wind_speed_10m": "double", "wind_direction_10m": "double", "weather_code": "int"}
SCHEMA = "struct<hourly:struct<time:array<string>," + ",".join(f"{k}:array<{v}>" for k, v in FIELDS.items()) + ">>"


def hourly(answers: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """lat2, lon2, hour_ms and values from rows of lat2, lon2 and body (JSON); arrays may be shorter than the times.

    Hours count from start to before end.
    """
    parsed = answers.select("lat2", "lon2", F.from_json("body", SCHEMA)["hourly"].alias("h"))
    rows = parsed.select("lat2", "lon2", "h", F.posexplode("h.time").alias("i", "time"))
    made = rows.select("lat2", "lon2", R.local_text_ms(c("time")).alias("hour_ms"), *(F.get(c(f"h.{k}"), c("i")).alias(k) for k in FIELDS)).where(c("hour_ms").isNotNull())
    if start is not None:
        made = made.where(c("hour_ms") >= start)
    if end is not None:
        made = made.where(c("hour_ms") < end)
    return made
