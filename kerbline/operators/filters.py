"""Optional predicates, parameter checks and limits shared by the queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domains as D


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def check_range(start: int | None, end: int | None) -> None:
    if start is not None and end is not None and start > end:
        raise ValueError("the range starts after its end")


def check_member(value: str | None, domain: tuple[str, ...]) -> None:
    if value is not None and value not in domain:
        raise ValueError(f"{value} is none of {', '.join(domain)}")


def parse_box(text: str) -> tuple[float, float, float, float]:
    """west, south, east, north from four comma-separated numbers."""
    try:
        west, south, east, north = (float(p) for p in text.split(","))
    except ValueError:
        raise ValueError("a box has four numbers") from None
    if not (west < east and south < north):
        raise ValueError("a box has a positive width and height")
    return west, south, east, north


@dataclass(frozen=True)
class EventFilter:
    """Criteria on events; those left at None add no predicate. Bounds in epoch milliseconds count themselves."""

    start: int | None = None
    end: int | None = None
    event_type: str | None = None
    ride_intent: str | None = None
    traffic_condition: str | None = None
    enrichments: tuple[str, ...] = ()

    def __post_init__(self):
        check_member(self.event_type, D.EVENT_TYPE)
        check_member(self.ride_intent, D.RIDE_INTENT)
        check_member(self.traffic_condition, D.TRAFFIC_CONDITION)
        for e in self.enrichments:
            check_member(e, D.ENRICHMENT_FILTER)

    def predicates(self) -> list[Column]:
        c = F.col
        out = []
        if self.start is not None:
            out.append(c("event_ts") >= self.start)
        if self.end is not None:
            out.append(c("event_ts") <= self.end)
        for name in ("event_type", "ride_intent", "traffic_condition"):
            if (value := getattr(self, name)) is not None:
                out.append(c(name) == value)
        flags = {"TRAFFIC_ENRICHED": c("traffic_enriched"), "WEATHER_ENRICHED": c("weather_enriched"), "OHSOME_ENRICHED": c("ohsome_enriched"), "TRAFFIC_MEASURED": c("traffic_status") == "ENRICHED"}
        return out + [flags[e] for e in self.enrichments]

    @property
    def active(self) -> bool:
        return bool(self.predicates())

    def apply(self, events: DataFrame) -> DataFrame:
        return events.where(reduce(lambda a, b: a & b, p)) if (p := self.predicates()) else events


def overlaps(valid_from: Column, valid_to: Column, start: Column, end: Column) -> Column:
    """Closed intervals that meet; a null end is open."""
    return (valid_from <= end) & (valid_to.isNull() | (valid_to >= start))


def overlaps_range(valid_from: Column, valid_to: Column, start: int | None, end: int | None) -> Column:
    """The same for a range whose bounds may be missing."""
    out = F.lit(True)
    if end is not None:
        out &= valid_from <= end
    if start is not None:
        out &= valid_to.isNull() | (valid_to >= start)
    return out


def known_value(value: Column, enriched: Column) -> Column:
    """An attribute that enrichment has found: neither blank nor a word for unknown."""
    return enriched & value.isNotNull() & (F.trim(value) != "") & (F.upper(F.trim(value)) != "UNKNOWN")


def valid_position(lat: Column, lon: Column, ts: Column) -> Column:
    """GPS samples with a time and a place other than the zero meridian or equator."""
    return lat.isNotNull() & lon.isNotNull() & ts.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180) & (lat != 0) & (lon != 0)


#: The country's box.
COUNTRY = {"south": 47.2, "north": 55.1, "west": 5.8, "east": 15.1}


def rides_in_country(points: DataFrame) -> DataFrame:
    """ride_id and inside: whether all located points lie in the country's box; true without located points."""
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    inside = F.col("lat").between(COUNTRY["south"], COUNTRY["north"]) & F.col("lon").between(COUNTRY["west"], COUNTRY["east"])
    return points.groupBy("ride_id").agg(F.coalesce(F.bool_and(F.when(located, inside)), F.lit(True)).alias("inside"))


def factors_of(factors: DataFrame, start: int | None = None, end: int | None = None, factor_type: str | None = None) -> DataFrame:
    """With both bounds those that overlap, of any type; else those of the type; else all."""
    if start is not None and end is not None:
        return factors.where(overlaps_range(F.col("valid_from"), F.col("valid_to"), start, end))
    if factor_type is not None:
        check_member(factor_type, D.FACTOR_TYPE)
        return factors.where(F.col("factor_type") == factor_type)
    return factors


def near_misses(incidents: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Scary located incidents within the bounds."""
    p = F.col("scary") & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    if start is not None:
        p &= F.col("ts") >= start
    if end is not None:
        p &= F.col("ts") <= end
    return incidents.where(p)


def detector_active(day: Column, active_from: Column, active_to: Column, removed: Column) -> Column:
    return ~F.coalesce(removed, F.lit(False)) & (active_from.isNull() | (active_from <= day)) & (active_to.isNull() | (active_to >= day))
