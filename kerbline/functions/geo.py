"""Geometry as column expressions: points are two columns, lines arrays of structs (lon, lat).

All of it stays in the JVM. Metric results use a local flat projection around the geometry, whose
error is far below the search radii at the scale of a city.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
M_PER_DEGREE = 111320.0
# The ellipsoid and grid of UTM zone 33 north.
UTM_AXIS, UTM_FLATTENING, UTM_SCALE, UTM_EAST, UTM_MERIDIAN = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0, 15.0


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres."""
    lat1, lon1, lat2, lon2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def flat_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres by degrees of latitude and of longitude at the mean latitude."""
    return F.hypot((lat2 - lat1) * M_PER_DEGREE, (lon2 - lon1) * M_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in degrees, -180 to 180."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def compass(degrees: Column) -> Column:
    """Degrees from 0 to below 360."""
    return F.pmod(degrees, F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """The angle between two bearings, 0 to 180."""
    return F.abs(((a - b + 540.0) % 360.0) - 180.0)


def legs(line: Column) -> Column:
    """A struct (p, q) for each pair of neighbouring vertices."""
    n = F.size(line)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at(line, i).alias("p"), F.element_at(line, i + 1).alias("q")))).otherwise(F.array())


def line_bearing(line: Column) -> Column:
    """Length-weighted circular mean of the legs' bearings, 0 to below 360; null with under two vertices.

    Legs without length don't count; if they cancel out, the bearing from start to end counts.
    """

    def add(acc, leg):
        p, q = leg["p"], leg["q"]
        size = flat_metres(p["lat"], p["lon"], q["lat"], q["lon"])
        way = F.radians(bearing(p["lat"], p["lon"], q["lat"], q["lon"]))
        return F.struct((acc["x"] + F.when(size > 0, F.cos(way) * size).otherwise(0.0)).alias("x"), (acc["y"] + F.when(size > 0, F.sin(way) * size).otherwise(0.0)).alias("y"))

    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    first, last = F.element_at(line, 1), F.element_at(line, -1)
    total = F.aggregate(legs(line), zero, add, lambda acc: F.when((F.abs(acc["x"]) > 1e-12) | (F.abs(acc["y"]) > 1e-12), F.degrees(F.atan2(acc["y"], acc["x"]))))
    return F.when(F.size(line) >= 2, compass(F.coalesce(total, bearing(first["lat"], first["lon"], last["lat"], last["lon"]))))


def _to_leg(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance from a point to a leg."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def point_line_degrees(lon: Column, lat: Column, line: Column) -> Column:
    """Planar distance in degrees from a point to a line."""
    return F.when(F.size(line) == 1, F.hypot(lon - line[0]["lon"], lat - line[0]["lat"])).otherwise(F.array_min(F.transform(legs(line), lambda s: _to_leg(lon, lat, s["p"]["lon"], s["p"]["lat"], s["q"]["lon"], s["q"]["lat"]))))


def point_line_metres(lon: Column, lat: Column, line: Column) -> Column:
    """Metres from a point to a line, in a flat projection at the point."""
    kx = F.cos(F.radians(lat)) * M_PER_DEGREE
    flat = F.transform(line, lambda v: F.struct(((v["lon"] - lon) * kx).alias("lon"), ((v["lat"] - lat) * M_PER_DEGREE).alias("lat")))
    return point_line_degrees(F.lit(0.0), F.lit(0.0), flat)


def line_position(lon: Column, lat: Column, line: Column) -> Column:
    """Where a line is nearest to a point: a struct of metres and share (of the line's length before that place, 0 to 1), in a flat projection at the point.

    The first of equally near places counts; null with under two vertices.
    """
    kx = F.cos(F.radians(lat)) * M_PER_DEGREE
    flat = lambda v: ((v["lon"] - lon) * kx, (v["lat"] - lat) * M_PER_DEGREE)

    def add(acc, leg):
        (ax, ay), (bx, by) = flat(leg["p"]), flat(leg["q"])
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / size))).otherwise(0.0)
        away, long = F.hypot(ax + t * dx, ay + t * dy), F.sqrt(size)
        nearer = acc["metres"].isNull() | (away < acc["metres"])
        return F.struct((acc["done"] + long).alias("done"), F.when(nearer, away).otherwise(acc["metres"]).alias("metres"), F.when(nearer, acc["done"] + t * long).otherwise(acc["at"]).alias("at"))

    zero = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("metres"), F.lit(0.0).alias("at"))
    place = lambda acc: F.struct(acc["metres"].alias("metres"), F.when(acc["done"] > 0, acc["at"] / acc["done"]).otherwise(0.0).alias("share"))
    return F.when(F.size(line) >= 2, F.aggregate(legs(line), zero, add, place))


def _crosses(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Whether two legs meet."""

    def side(a, b, c):
        return (b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"])

    return (side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)


def line_line_metres(a: Column, b: Column) -> Column:
    """Metres between two lines: 0 where they cross, else the least distance of a vertex to the other line."""
    crossing = F.exists(legs(a), lambda x: F.exists(legs(b), lambda y: _crosses(x["p"], x["q"], y["p"], y["q"])))
    ends = F.least(F.array_min(F.transform(a, lambda v: point_line_metres(v["lon"], v["lat"], b))), F.array_min(F.transform(b, lambda v: point_line_metres(v["lon"], v["lat"], a))))
    return F.when(crossing, 0.0).otherwise(ends)


def meets_box(line: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a line truly meets a rectangle: each leg is clipped against the four sides."""

    def leg_meets(leg):
        x, y = leg["p"]["lon"], leg["p"]["lat"]
        dx, dy = leg["q"]["lon"] - x, leg["q"]["lat"] - y

        def span(at, d, low, high):
            inside = (at >= low) & (at <= high)
            a, b = (low - at) / d, (high - at) / d
            return F.when(d != 0, F.least(a, b)).when(inside, F.lit(0.0)), F.when(d != 0, F.greatest(a, b)).when(inside, F.lit(1.0))

        (x0, x1), (y0, y1) = span(x, dx, west, east), span(y, dy, south, north)
        return F.coalesce(F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0)), F.lit(False)) & x0.isNotNull() & y0.isNotNull()

    return F.exists(legs(line), leg_meets)


def box(line: Column) -> dict[str, Column]:
    lon, lat = F.transform(line, lambda v: v["lon"]), F.transform(line, lambda v: v["lat"])
    return {"min_lon": F.array_min(lon), "min_lat": F.array_min(lat), "max_lon": F.array_max(lon), "max_lat": F.array_max(lat)}


def centroid(line: Column) -> Column:
    """The length-weighted mean of the legs' middles (lon, lat); the first vertex if there is no length."""

    def add(acc, leg):
        p, q = leg["p"], leg["q"]
        size = F.hypot(q["lon"] - p["lon"], q["lat"] - p["lat"])
        return F.struct((acc["w"] + size).alias("w"), (acc["x"] + size * (p["lon"] + q["lon"]) / 2).alias("x"), (acc["y"] + size * (p["lat"] + q["lat"]) / 2).alias("y"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    first = line[0]
    return F.aggregate(legs(line), zero, add, lambda a: F.when(a["w"] > 0, F.struct((a["x"] / a["w"]).alias("lon"), (a["y"] / a["w"]).alias("lat"))).otherwise(F.struct(first["lon"].alias("lon"), first["lat"].alias("lat"))))


def utm33(lon: Column, lat: Column) -> tuple[Column, Column]:
    """East and north metres in UTM zone 33, by the series in the third flattening."""
    n = UTM_FLATTENING / (2 - UTM_FLATTENING)
    radius = UTM_AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - UTM_MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = reduce(lambda a, b: a + b, (a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)), eta)
    north = reduce(lambda a, b: a + b, (a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)), xi)
    return UTM_EAST + UTM_SCALE * radius * east, UTM_SCALE * radius * north


def overlap_ratio(shortest: Column, actual: Column, radius: float = 20.0) -> Column:
    """Share of the shortest line's length within the radius of the actual line, 0 to 1; null without length.

    For each pair of legs, the places of the one within reach of the other form one interval, as
    distance to a straight leg is convex; the union of the intervals is measured exactly.
    """
    lat0 = F.element_at(shortest, 1)["lat"]
    kx, ky = F.cos(F.radians(lat0)) * M_PER_DEGREE, F.lit(M_PER_DEGREE)
    r = F.lit(float(radius))

    def flat(v, o):
        return (v["lon"] - o["lon"]) * kx, (v["lat"] - o["lat"]) * ky

    def interval(leg, other):
        (dx, dy), (ax, ay) = flat(leg["q"], leg["p"]), flat(other["p"], leg["p"])
        bx, by = flat(other["q"], leg["p"])
        ex, ey = bx - ax, by - ay
        size, other_size = dx * dx + dy * dy, ex * ex + ey * ey

        def circle(cx, cy):  # |p + t d - c| <= r
            half = (dx * cx + dy * cy) / size
            root = half * half - (cx * cx + cy * cy - r * r) / size
            return F.when(root >= 0, half - F.sqrt(root)), F.when(root >= 0, half + F.sqrt(root))

        def band(base, slope, low, high):  # low <= base + t * slope <= high
            inside = (base >= low) & (base <= high)
            return F.when(slope != 0, F.least((low - base) / slope, (high - base) / slope)).when(inside, F.lit(-1e9)), F.when(slope != 0, F.greatest((low - base) / slope, (high - base) / slope)).when(inside, F.lit(1e9))

        length = F.sqrt(other_size)
        along = band(-(ax * ex + ay * ey) / length, (dx * ex + dy * ey) / length, F.lit(0.0), length)
        across = band((ax * -ey + ay * ex) / length * -1, (dx * -ey + dy * ex) / length, -r, r)
        both = along[0].isNotNull() & across[0].isNotNull() & (F.greatest(along[0], across[0]) <= F.least(along[1], across[1])) & (other_size > 0)
        strip = F.when(both, F.greatest(along[0], across[0])), F.when(both, F.least(along[1], across[1]))
        c1, c2 = circle(ax, ay), circle(bx, by)
        low, high = F.least(c1[0], c2[0], strip[0]), F.greatest(c1[1], c2[1], strip[1])
        found = low.isNotNull()  # greatest and least skip nulls
        return F.struct(F.when(found, F.greatest(low, F.lit(0.0))).alias("lo"), F.when(found, F.least(high, F.lit(1.0))).alias("hi"))

    def covered(leg):
        found = F.array_sort(F.filter(F.transform(legs(actual), lambda other: interval(leg, other)), lambda s: s["lo"] < s["hi"]))
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("end"))
        step = lambda acc, s: F.struct((acc["sum"] + F.greatest(F.lit(0.0), s["hi"] - F.greatest(s["lo"], acc["end"]))).alias("sum"), F.greatest(acc["end"], s["hi"]).alias("end"))
        return F.aggregate(found, zero, step, lambda acc: acc["sum"])

    def length(leg):
        dx, dy = flat(leg["q"], leg["p"])
        return F.hypot(dx, dy)

    add = lambda acc, x: acc + x
    real = F.filter(legs(shortest), lambda leg: length(leg) > 0)
    total = F.aggregate(F.transform(real, length), F.lit(0.0), add)
    near = F.aggregate(F.transform(real, lambda leg: covered(leg) * length(leg)), F.lit(0.0), add)
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), near / total)))


def line_text(line: Column) -> Column:
    """Well-known text of a line."""
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(line, lambda v: F.concat_ws(" ", v["lon"].cast("string"), v["lat"].cast("string"))), ","), F.lit(")"))


def line_json(line: Column, digits: int = 6) -> Column:
    """A GeoJSON LineString as a struct."""
    return F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda v: F.array(F.round(v["lon"], digits), F.round(v["lat"], digits))).alias("coordinates"))


def stitch(edges: Column) -> Column:
    """One line from edges' lines in order: all but the first edge lose their first vertex."""
    return F.flatten(F.transform(edges, lambda e, i: F.when(i == 0, e).otherwise(F.slice(e, F.lit(2), F.greatest(F.size(e) - 1, F.lit(0))))))


def gradient(start: Column, end: Column, metres: Column) -> Column:
    """Percent of rise; 0 for edges under a metre, null without elevations."""
    return F.when(start.isNotNull() & end.isNotNull(), F.when(metres < 1.0, 0.0).otherwise((end - start) / metres * 100.0))


def grown_box(west: float, south: float, east: float, north: float, metres: float = 75.0) -> tuple[float, float, float, float]:
    """A box enlarged on all sides, within the world."""
    from math import cos, radians

    up = metres / M_PER_DEGREE
    side = up / max(cos(radians((south + north) / 2)), 0.01)
    return max(-180.0, west - side), max(-90.0, south - up), min(180.0, east + side), min(90.0, north + up)
