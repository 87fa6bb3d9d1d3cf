"""Domain rules as pure column expressions: times, streets, buckets, classifications, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import domains as D
from .geo import turn

ZONE = "Europe/Berlin"
HOUR_MS = 3_600_000


def lookup(key: Column, table: dict, default: str | None = None) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def ladder(value: Column, steps: list[tuple[float, str]], last: str, missing: str = "UNKNOWN") -> Column:
    """The label of the first step that the value is below; `missing` for null."""
    out = F.when(value.isNull(), missing)
    for limit, label in steps:
        out = out.when(value < limit, label)
    return out.otherwise(last)


# --- time -------------------------------------------------------------------------------------


def local_time(ms: Column) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms), ZONE)


def day_of_week(ms: Column) -> Column:
    """Upper-case English name of the local day."""
    return F.upper(F.date_format(local_time(ms), "EEEE"))


def hour_of_day(ms: Column) -> Column:
    return F.hour(local_time(ms))


def hour_floor(ms: Column) -> Column:
    """The start of the hour, cut towards zero as the remainder is."""
    return ms - ms % HOUR_MS


def utc_year(ms: Column) -> Column:
    return F.year(F.timestamp_millis(ms))


def local_text_ms(text: Column) -> Column:
    """Epoch milliseconds of local ISO date-times, or else of dd.MM.yyyy HH:mm; null for other texts."""
    # A text is tried with the one pattern that its end allows: a pattern that doesn't fit costs an exception.
    ends = {"yyyy-MM-dd'T'HH:mm:ss": r"(?i)T\d\d:\d\d:\d\d$", "yyyy-MM-dd'T'HH:mm": r"(?i)T\d\d:\d\d$", "dd.MM.yyyy HH:mm": r" \d\d:\d\d$"}
    iso = F.coalesce(*(F.when(text.rlike(end), F.try_to_timestamp(text, F.lit(p))) for p, end in ends.items()))
    return F.unix_millis(F.to_utc_timestamp(iso, ZONE))


def instant_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO instant with an offset; null for other texts."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$"), F.unix_millis(F.try_to_timestamp(text)))


# --- tolerant scalars -------------------------------------------------------------------------


def tolerant_double(text: Column) -> Column:
    """Null for blanks, `nan` and garbage."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def tolerant_int(text: Column) -> Column:
    """The whole part of a number."""
    return tolerant_double(text).cast("int")


def tolerant_date(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(F.trim(text), F.lit("dd.MM.yyyy")).cast("date"), F.trim(text).try_cast("date"))


def not_minus_one(value: Column) -> Column:
    return F.when(value != -1.0, value)


# --- streets ----------------------------------------------------------------------------------


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def _either_contains(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def traffic_street(name: Column) -> Column:
    return F.trim(F.replace(F.replace(F.lower(name), F.lit("str."), F.lit("straße")), F.lit("strasse"), F.lit("straße")))


def traffic_streets_match(segment: Column, detector: Column) -> Column:
    """Blank or unknown names never match."""
    usable = (F.trim(segment) != "") & (F.trim(detector) != "") & (F.lower(segment) != "unknown")
    return F.coalesce(usable & _either_contains(traffic_street(segment), traffic_street(detector)), F.lit(False))


def closure_streets_match(segment: Column, closure: Column) -> Column:
    """Blank or Unknown names match every street."""
    plain = lambda c: F.replace(F.lower(c), F.lit("str."), F.lit("straße"))
    open_ = lambda c: c.isNull() | (F.trim(c) == "") | (F.lower(c) == "unknown")
    return open_(segment) | open_(closure) | _either_contains(plain(segment), plain(closure))


def direction_degrees(word: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in D.COMPASS.items() for x in kv))
    return F.try_element_at(pairs, F.lower(F.trim(word)))


# --- ride rules -------------------------------------------------------------------------------


def share(part: Column, whole: Column) -> Column:
    """Null where the whole is 0."""
    return F.when(whole > 0, part / whole)


def avoidance_ratio(usage: Column, avoidance: Column) -> Column:
    return share(avoidance, usage + avoidance)


def preference_ratio(usage: Column, preference: Column) -> Column:
    return share(preference, usage)


def route_comparison(actual: Column, shortest: Column, overlap: Column, detour: float = 0.10, corridor: float = 0.30) -> Column:
    """The kind of route; null for metrics that can't be: a negative or NaN length, a shortest of 0, an overlap outside 0 to 1."""
    sound = (actual >= 0) & ~F.isnan(actual) & (shortest > 0) & ~F.isnan(shortest) & (overlap >= 0) & (overlap <= 1)
    return F.when(sound, F.when(actual <= shortest * (1 + detour), "EQUIVALENT_ROUTE").when(overlap < corridor, "CORRIDOR_ALTERNATIVE").otherwise("LOCAL_DETOUR"))


def ride_intent_score(r: dict[str, Column]) -> Column:
    """Sum of signals for commuting (positive) or leisure. r: columns by name, any may be null."""
    start, minutes = local_time(r["start_ms"]), ((r["end_ms"] - r["start_ms"]) / 60_000).cast("long")
    seconds = ((r["end_ms"] - r["start_ms"]) / 1000).cast("long")
    timed = r["start_ms"].isNotNull() & r["end_ms"].isNotNull()
    hour, minute = F.hour(start), F.minute(start)
    peak = hour.between(6, 8) | hour.isin(17, 18) | ((hour == 19) & (minute <= 30))
    pace = F.when(seconds > 0, r["actual_distance"] / seconds * 3.6)
    kind, ratio = r["route_comparison_type"], F.when(r["shortest_distance"] > 0, r["actual_distance"] / r["shortest_distance"])
    signals = [
        F.when(timed, F.when(F.dayofweek(start).isin(1, 7), -2).when(peak, 2).otherwise(1)),
        F.when(timed, F.when(minutes.between(15, 50), 1).when(minutes > 50, -1)),
        F.when(timed, F.when(pace.between(12.0, 22.0), 1).when((pace < 10.0) | (pace > 28.0), -1)),
        F.when(kind == "EQUIVALENT_ROUTE", 1).when(kind == "LOCAL_DETOUR", -1).when(kind == "CORRIDOR_ALTERNATIVE", -3).when(~r["is_detour"], 1).when(r["is_detour"], -1),
        F.when(r["overlap_ratio"] >= 0.85, 1),
        F.when(ratio <= 1.15, 1).when(ratio >= 1.5, -2),
        F.when(r["child_transport"], 1),
        F.when(r["trailer_attached"], -1),
        F.when(r["bike_type"].isin("ROAD_RACING_BIKE", "MOUNTAIN_BIKE"), -1).when(r["bike_type"].isin("CITY_TREKKING_BIKE", "E_BIKE", "FREIGHT_BICYCLE"), 1),
    ]
    return sum((F.coalesce(s, F.lit(0)) for s in signals), F.lit(0))


def ride_intent(r: dict[str, Column], confidence: int = 2) -> Column:
    score = ride_intent_score(r)
    known = r["status"] == "PROCESSED"
    return F.when(known & (score >= confidence), "COMMUTE").when(known & (score <= -confidence), "LEISURE").otherwise("UNKNOWN")


def wind_exposure(bearing: Column, wind: Column) -> Column:
    """Null without both directions."""
    angle = turn(bearing, wind)
    return F.when(angle <= 45, "HEADWIND").when(angle >= 135, "TAILWIND").when(angle.isNotNull(), "CROSSWIND")


def traffic_condition(volume: Column, speed: Column) -> Column:
    slow = lambda limit: F.coalesce(speed <= limit, F.lit(False))
    dense = lambda limit, strict=False: F.coalesce(volume > limit if strict else volume >= limit, F.lit(False))
    free = F.coalesce(volume <= 150, F.lit(False)) & (speed.isNull() | (speed > 30))
    return F.when(volume.isNull() & speed.isNull(), "UNKNOWN").when(slow(20) & dense(150, True), "CONGESTED").when(slow(30) | dense(800), "HEAVY").when(free, "LIGHT").otherwise("MODERATE")


def detector_score(rank: Column, same_street: Column, delta: Column) -> Column:
    """rank: from 0, the nearest first."""
    near = F.greatest(F.lit(0.0), 100.0 - 3.0 * rank)
    return near + F.when(same_street, 25.0).otherwise(0.0) + F.when(delta <= 45, 20.0).when(delta <= 90, 8.0).when(delta >= 135, -20.0).otherwise(0.0)


def measurement_usable(source: Column, volume: Column, speed: Column, quality: Column, completeness: Column) -> Column:
    """Volumes aren't negative, speeds lie in 0 to 160, and the source's own measure of quality is met; a missing one isn't."""
    plausible = (volume.isNull() | (volume >= 0)) & (speed.isNull() | speed.between(0, 160))
    good = F.when(source == "NEW_DETECTOR", completeness >= 75).otherwise(quality >= 0.75)
    return plausible & F.coalesce(good, F.lit(False))


PRIOR_EVENTS = 5


def balance(avoidance: Column, preference: Column) -> Column:
    total = avoidance + preference
    return F.when(total > 0, (preference - avoidance) / (total + PRIOR_EVENTS)).otherwise(0.0)


# The signal's labels by bounds.
SIGNALS = ((0.9, "EXTREME"), (0.6, "STRONG"), (0.3, ""), (0.1, "LIGHT"))


def signal(events: Column, value: Column) -> Column:
    out = F.when(events == 0, "NO_EVENTS")
    for sign, name in ((-1, "AVOIDANCE"), (1, "PREFERENCE")):
        for bound, grade in SIGNALS:
            out = out.when(value * sign >= bound, f"{name}_{grade}".rstrip("_"))
    return out.otherwise("BASELINE")


# --- decoders ---------------------------------------------------------------------------------


def bike_type(code: Column) -> Column:
    return lookup(code.cast("int"), dict(enumerate(D.BIKE_TYPE)), "NOT_CHOSEN")


def phone_location(code: Column) -> Column:
    return lookup(code.cast("int"), dict(enumerate(D.PHONE_LOCATION)), "OTHER")


def incident_type(code: Column) -> Column:
    return lookup(code.cast("int"), D.INCIDENT_TYPE, "NOTHING")


def participant_type(code: Column) -> Column:
    return lookup(code.cast("int"), D.PARTICIPANT_TYPE, "OTHER")


def closure_severity(text: Column) -> Column:
    return lookup(text, D.CLOSURE_SEVERITY, "UNKNOWN")


def closure_factor(subtype: Column) -> Column:
    return lookup(subtype, D.CLOSURE_FACTOR, "ROAD_CLOSURE")


def cycleway_type(value: Column) -> Column:
    return F.when(value.isNotNull(), lookup(F.lower(value), D.CYCLEWAY_TYPE, "UNKNOWN"))


# --- map tags ---------------------------------------------------------------------------------

# What older spellings of the cycleway tag stand for.
OLD_CYCLEWAY = {"opposite": "no", "opposite_lane": "lane", "opposite_track": "track"}
# Sides in the order in which they count, with the tag's prefix.
SIDES = (("BOTH", "cycleway:both"), ("RIGHT", "cycleway:right"), ("LEFT", "cycleway:left"), ("UNKNOWN", "cycleway"))


def tag_columns(tags: Column) -> dict[str, Column]:
    """Event columns from a map of OpenStreetMap tags."""
    get = lambda k: F.try_element_at(tags, F.lit(k))
    old = get("cycleway").isin(*OLD_CYCLEWAY)
    plain = F.when(old, lookup(get("cycleway"), OLD_CYCLEWAY)).otherwise(get("cycleway"))
    oneway = F.coalesce(get("oneway:bicycle"), F.when(old, "no"))
    has = {side: F.map_contains_key(tags, F.lit(key)) for side, key in SIDES}

    def by_side(values: dict[str, Column], otherwise: Column) -> Column:
        out = F.when(F.lit(False), otherwise)
        for side, _ in SIDES:
            out = out.when(has[side], values[side])
        return out.otherwise(otherwise)

    null = F.lit(None).cast("string")
    value = by_side({s: plain if s == "UNKNOWN" else get(k) for s, k in SIDES}, null)
    kind = cycleway_type(value)
    built = kind.isNotNull() & (kind != "NO")
    return {
        "cycleway_type": kind,
        "cycleway_location": by_side({s: F.lit(s) for s, _ in SIDES}, F.lit("NONE")),
        "cycleway_surface": F.when(built, F.coalesce(by_side({s: get(f"{k}:surface") for s, k in SIDES}, null), get("surface"))),
        "cycleway_width": F.when(built, by_side({s: get(f"{k}:width") for s, k in SIDES}, null).try_cast("double")),
        "bicycle_oneway": F.when(oneway == "yes", True).when(oneway.isin("no", "-1"), False),
        **{c: get(c) for c in ("highway", "surface", "smoothness", "lit")},
    }
