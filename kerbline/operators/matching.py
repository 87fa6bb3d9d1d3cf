"""Map matching: a hidden Markov model over a cell index and bounded shortest ways.

A ride is one row with its points. Rides are dealt by the tile of their first point in portions of about PORTION points. A portion meets the arcs of the cells of its points and
those within WAY_METRES of them, and its candidates are found, its moves scored and its rides decoded there, for all of its rides at once. So neither candidates nor moves nor
ridden edges are rows of a shuffle (points are, twice), nothing is collected, and a task holds one portion and the arcs around it.

The model: a candidate's log-chance is -(metres / SIGMA)^2 / 2, a step's -|way - crow| / BETA, where the way runs along the network and the crow flies
between the points. Ways are added up in whole micrometres, shares of edges and scores rounded to SHARE_DIGITS and SCORE_DIGITS digits. Of equal ways the one with the
smaller edge ids counts (compared from the start), of equal scores the candidate with the smaller edge id, forward first.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geo import EARTH_M, M_PER_DEGREE, line_position
from .components import ready_to_checkpoint
from .spatial import CELL_RADII, RINGS, line_cells, points_near_lines, sorted_join, steps

c = F.col
SIGMA, BETA, REACH, WAY_METRES, SCORE_DIGITS, SHARE_DIGITS = 10.0, 30.0, 60.0, 500.0, 6, 9
MICRO = 1_000_000
#: Points that are decoded together, and their moves that are scored at once.
PORTION, MOVES = 20_000, 1_000_000
#: Points that are so many metres farther away than the nearest one may still be as near, to the micrometre.
NEARLY = 1e-5


def micrometres(metres: Column) -> Column:
    return F.round(metres * MICRO).cast("long")


def directed(edges: DataFrame) -> DataFrame:
    """edge_id, ahead, source, target, length (micrometres), metres, the source's place (lon, lat) and the edge's line: a row for each way in which an edge may be ridden.

    edges: edge_id, from_node, to_node, metres, forward, backward, line (from from_node to to_node).
    """
    first, last, length = F.element_at("line", 1), F.element_at("line", -1), micrometres(c("metres"))
    shared = lambda ahead, a, b, at: ["edge_id", F.lit(ahead).alias("ahead"), c(a).alias("source"), c(b).alias("target"), length.alias("length"), "metres", at["lon"].alias("lon"), at["lat"].alias("lat"), "line"]
    usable = edges.where(F.size("line") >= 2)
    return usable.where("forward").select(*shared(True, "from_node", "to_node", first)).unionByName(usable.where("backward").select(*shared(False, "to_node", "from_node", last)))


def candidates(points: DataFrame, edges: DataFrame, reach: float = REACH) -> DataFrame:
    """ride_id, n, lat, lon, edge_id, ahead, source, target, length, metres and share: the directed edges within reach of each point.

    points: ride_id, n (the point's place in its ride), lat, lon. A point meets the edges of its own cell, whose size is the reach; share is that of the edge ridden before the point.
    """
    lines = edges.where(F.size("line") >= 2).select("edge_id", "line", "from_node", "to_node", micrometres(c("metres")).alias("length"), "forward", "backward")
    near = points_near_lines(points, lines, reach).withColumn("share", F.round(line_position(c("lon"), c("lat"), c("line"))["share"], SHARE_DIGITS))
    way = lambda ahead, a, b, share: F.struct(F.lit(ahead).alias("ahead"), c(a).alias("source"), c(b).alias("target"), share.alias("share"))
    ways = F.array_compact(F.array(F.when(c("forward"), way(True, "from_node", "to_node", c("share"))), F.when(c("backward"), way(False, "to_node", "from_node", F.round(1 - c("share"), SHARE_DIGITS)))))
    return near.select("ride_id", "n", "lat", "lon", "edge_id", "length", "metres", F.explode(ways).alias("w")).select("ride_id", "n", "lat", "lon", "edge_id", "w.ahead", "w.source", "w.target", "length", "metres", "w.share")


def _ways_from(arcs: dict, start: int, goals: set, most: int) -> Iterator[tuple]:
    """goal, length and edges of the shortest way to each goal, up to a length."""
    queue, done = [(0, (), start)], set()
    left = set(goals)
    while queue and left:
        length, edges, node = heapq.heappop(queue)
        if node in done:
            continue
        done.add(node)
        if node in left:
            left.remove(node)
            yield node, length, list(edges)
        for target, size, edge in arcs.get(node, ()):
            if target not in done and length + size <= most:
                heapq.heappush(queue, (length + size, (*edges, edge), target))


def _node_cells(arcs: DataFrame, metres: float) -> DataFrame:
    """node and x, y of its grid cell of that size."""
    dx, dy = steps(metres)
    return arcs.groupBy(c("source").alias("node")).agg(F.min(F.floor(c("lon") / dx)).cast("long").alias("x"), F.min(F.floor(c("lat") / dy)).cast("long").alias("y"))


def bounded_ways(pairs: DataFrame, edges: DataFrame, metres: float = WAY_METRES) -> DataFrame:
    """source, target, length (micrometres) and edges of the shortest way of each distinct pair (source, target), where one of at most so many metres exists.

    Nodes lie in grid cells of that size; a cell's sources are searched among the edges that start in it or a
    neighbouring cell, which hold all ways of that length, as no edge is shorter than the crow flies.
    """
    arcs = directed(edges)
    at = _node_cells(arcs, metres)
    wanted = pairs.select("source", "target").distinct().join(at.withColumnRenamed("node", "source"), "source")
    around = lambda k: F.explode(F.sequence(c(k) - 1, c(k) + 1))
    spread = arcs.join(at.withColumnRenamed("node", "source"), "source").select("edge_id", "source", "target", "length", around("x").alias("x"), "y").withColumn("y", around("y"))
    spread = spread.join(wanted.select("x", "y").distinct(), ["x", "y"], "left_semi")
    most = int(round(metres * MICRO))

    def search(want: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        goals, out, found = {}, {}, []
        for a, b in zip(want["source"].tolist(), want["target"].tolist(), strict=True):
            goals.setdefault(a, set()).add(b)
        for a, b, size, edge in zip(*(arcs[k].tolist() for k in ("source", "target", "length", "edge_id")), strict=True):
            out.setdefault(a, []).append((b, size, edge))
        for a, ends in goals.items():
            found += [(a, *row) for row in _ways_from(out, a, ends, most)]
        return pd.DataFrame(found, columns=["source", "target", "length", "edges"])

    kinds = dict(arcs.dtypes)
    schema = f"source {kinds['source']}, target {kinds['target']}, length long, edges array<{kinds['edge_id']}>"
    return wanted.groupBy("x", "y").cogroup(spread.groupBy("x", "y")).applyInPandas(search, schema)


def ride_rows(points: DataFrame, *more: str) -> DataFrame:
    """ride_id and points: a row for each ride with its located points (ts, lat, lon and `more`) in that order."""
    place = F.when(c("lat").isNotNull() & c("lon").isNotNull(), F.struct("ts", "lat", "lon", *more))
    return points.groupBy("ride_id").agg(F.sort_array(F.collect_list(place)).alias("points"))


def dealt(rides: DataFrame, metres: float, most: int = PORTION) -> DataFrame:
    """rides (ride_id and points, at least one) with their tile and portion, by which they are partitioned.

    A ride's tile is the grid cell of its first point. The tiles of more than `most` points are broadcast, at most one for each so many points.
    """
    (dx, dy), first = steps(metres), F.get("points", F.lit(0))
    placed = rides.withColumn("tile", F.struct(F.floor(first["lon"] / dx).cast("long").alias("x"), F.floor(first["lat"] / dy).cast("long").alias("y")))
    crowded = placed.groupBy("tile").agg(F.sum(F.size("points")).alias("size")).where(c("size") > most).select("tile", F.ceil(c("size") / most).alias("parts"))
    portion = F.pmod(F.xxhash64("ride_id"), F.coalesce("parts", F.lit(1)))
    return placed.join(F.broadcast(crowded), "tile", "left").select("ride_id", "points", "tile", portion.alias("portion")).repartition("tile", "portion")


def portions(points: DataFrame, metres: float, most: int = PORTION) -> DataFrame:
    """The rides of points (ride_id, lat, lon, ts) that have a located point, dealt."""
    return dealt(ride_rows(points).where(F.size("points") > 0), metres, most)


def _cells_of(placed: DataFrame, dx: float, dy: float) -> DataFrame:
    """near_tile, near_portion and the distinct cells of its points.

    Batches pass whole, so that the shuffle of placed is the one that the decoding reads, too.
    """
    kinds = placed.schema
    schema = T.StructType([T.StructField("near_tile", kinds["tile"].dataType), T.StructField("near_portion", kinds["portion"].dataType), T.StructField("cell", kinds["tile"].dataType)])
    arrow = to_arrow_schema(schema)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("points")
            of, flat = np.repeat(np.arange(len(points)), points.value_lengths().to_numpy()), points.flatten()
            x, y = (np.floor(flat.field(k).to_numpy() / size).astype(np.int64) for k, size in (("lon", dx), ("lat", dy)))
            of, x, y = np.unique(np.stack([of, x, y]), axis=1)
            cell = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(arrow.field("cell").type))
            yield pa.RecordBatch.from_arrays([batch.column("tile").take(pa.array(of)), batch.column("portion").take(pa.array(of)), cell], schema=arrow)

    return placed.mapInArrow(cells, schema).distinct()


def arcs_around(placed: DataFrame, edges: DataFrame, reach: float, metres: float) -> DataFrame:
    """near_tile, near_portion and the arcs (edge_id, ahead, source, target, length, metres, line) that ways of at most so many metres from a portion's candidates may take."""
    dx, dy = steps(CELL_RADII * reach)
    arcs = directed(edges)
    at = _node_cells(arcs, metres)
    cells = _cells_of(placed, dx, dy)
    ends = edges.where(F.size("line") >= 2).select(F.array("from_node", "to_node").alias("nodes"), F.explode(line_cells(c("line"), dx, dy, reach)).alias("cell"))
    touched = sorted_join(ends, cells.select("cell").distinct(), "cell", "left_semi").select("cell", F.explode("nodes").alias("node")).distinct()
    squares = sorted_join(touched, at, "node").select("cell", "x", "y").distinct()
    used = sorted_join(cells, squares, "cell").select("near_tile", "near_portion", "x", "y").distinct()
    around = lambda k: F.explode(F.sequence(c(k) - 1, c(k) + 1)).alias(k)
    needed = used.select("near_tile", "near_portion", around("x"), "y").select("near_tile", "near_portion", "x", around("y")).distinct()
    there = sorted_join(arcs, at.withColumnRenamed("node", "source"), "source")
    return sorted_join(needed, there, ["x", "y"]).select("near_tile", "near_portion", "edge_id", "ahead", "source", "target", "length", "metres", "line")


def _first_best(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of the first largest value of each run (none is empty)."""
    if not len(starts):
        return np.zeros(0, np.int64)
    best = np.repeat(np.maximum.reduceat(values, starts), np.diff(np.append(starts, len(values))))
    return np.minimum.reduceat(np.where(values == best, np.arange(len(values)), len(values)), starts)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each run of those sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _in_cells(lon: np.ndarray, lat: np.ndarray, legs: list[np.ndarray], arc: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a point and an arc with a leg (lon, lat, lon, lat; arc: whose) whose box, grown by the reach, meets the point's grid cell; sorted by point and arc."""
    dx, dy = steps(CELL_RADII * reach)
    high = reach / M_PER_DEGREE * (1 + 1e-9)
    narrow = [np.maximum(np.abs(np.cos(np.radians(x))) - np.radians(high), 0.01) for x in (legs[1], legs[3])]
    wide = high / np.minimum(*narrow)
    floor = lambda x, size: np.floor(x / size).astype(np.int64)
    x0, x1 = floor(np.minimum(legs[0], legs[2]) - wide, dx), floor(np.maximum(legs[0], legs[2]) + wide, dx)
    y0, y1 = floor(np.minimum(legs[1], legs[3]) - high, dy), floor(np.maximum(legs[1], legs[3]) + high, dy)
    cells, which = np.unique(np.stack([floor(lon, dx), floor(lat, dy)]), axis=1, return_inverse=True)
    # The cells of points are sorted by x and y, so a leg meets a run of them in each column.
    columns = np.unique(cells[0])
    low, top = np.searchsorted(columns, x0), np.searchsorted(columns, x1, "right")
    leg = np.repeat(np.arange(len(arc)), top - low)
    column = np.repeat(low, top - low) + _within(top - low)
    span = int(cells[1].max() - cells[1].min()) + 3
    key = np.searchsorted(columns, cells[0]) * span + cells[1] - cells[1].min() + 1
    bound = lambda y: column * span + np.clip(y[leg] - cells[1].min() + 1, 0, span - 1)
    start, end = np.searchsorted(key, bound(y0)), np.searchsorted(key, bound(y1), "right")
    met = np.unique((np.repeat(start, end - start) + _within(end - start)) * (arc.max(initial=0) + 1) + np.repeat(arc[leg], end - start))
    cell, arc = np.divmod(met, arc.max(initial=0) + 1)
    n, which = np.bincount(cell, minlength=cells.shape[1]), which.reshape(-1)
    size = n[which]
    at = np.repeat((np.cumsum(n) - n)[which], size) + _within(size)
    return np.repeat(np.arange(len(lon)), size), arc[at]


def _apart(lat: np.ndarray, lon: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Great-circle metres between places in radians."""
    h = np.sin((lat2 - lat) / 2) ** 2 + np.cos(lat) * np.cos(lat2) * np.sin((lon2 - lon) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1, h)))


def near_points(at: np.ndarray, lon: np.ndarray, lat: np.ndarray, of: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a place (ride `at`, lon, lat) and a point (ride `of`, x, y) of its ride that is no more than NEARLY farther away than the nearest; sorted by place.

    A place meets the points of its cell and the eight around it, first in small cells, as in spatial.nearest_in_group; the last cells hold whole rides.
    """
    left, made, top = np.arange(len(at)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))], min(float(np.abs(y).max(initial=0)) + 1, 89.0)
    for metres in (*RINGS, None):
        dx, dy = steps(metres, top) if metres else (1e9, 1e9)
        cell = lambda v, size, low: np.floor(v / size).astype(np.int64) - low
        low_x, low_y = cell(x, dx, 0).min(initial=0), cell(y, dy, 0).min(initial=0)
        px, py = cell(x, dx, low_x), cell(y, dy, low_y)
        wide, high = int(px.max(initial=0)) + 1, int(py.max(initial=0)) + 1
        keys = (of * wide + px) * high + py
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        # The points of three cells above each other are one run.
        column, row = cell(lon[left], dx, low_x)[:, None] + np.array([-1, 0, 1]), cell(lat[left], dy, low_y)[:, None]
        inside = (column >= 0) & (column < wide) & (row + 1 >= 0) & (row - 1 < high)
        base = (at[left][:, None] * wide + column) * high
        start = np.searchsorted(keys, base + np.clip(row - 1, 0, high - 1))
        size = np.where(inside, np.searchsorted(keys, base + np.clip(row + 1, 0, high - 1), "right") - start, 0)
        sums, done, first = np.cumsum(size.sum(axis=1)), np.zeros(len(left), bool), 0
        while first < len(left):
            end = max(first + 1, int(np.searchsorted(sums, (sums[first - 1] if first else 0) + MOVES)))
            k = size[first:end].ravel()
            which = np.repeat(np.arange(first, end), size[first:end].sum(axis=1))
            point, place = order[np.repeat(start[first:end].ravel(), k) + _within(k)], left[which]
            away = _apart(*(np.radians(v) for v in (lat[place], lon[place], y[point], x[point])))
            best = np.full(len(left), np.inf)
            runs = np.flatnonzero(np.append(True, which[1:] != which[:-1])[: len(which)])
            if len(runs):
                best[which[runs]] = np.minimum.reduceat(away, runs)
            sure = np.isfinite(best) & (best <= (metres * (1 - 1e-6) if metres else np.inf))
            done |= sure
            kept = sure[which] & (away <= best[which] + NEARLY)
            made.append((place[kept], point[kept]))
            first = end
        left = left[~done]
    place, point = (np.concatenate(v) for v in zip(*made, strict=True))
    order = np.argsort(place, kind="stable")
    return place[order], point[order]


class Portion:
    """The points of a portion's rides that have an arc in reach, sorted by ride and n, with the arcs in reach as candidates, and all arcs around them."""

    def __init__(self, rides: pa.Table, arcs: pa.Table, sigma: float, beta: float, reach: float, most: int, digits: int):
        whole = lambda column: column.combine_chunks()
        lists = whole(rides["points"])
        self.rides, self.points, self.of = len(lists), lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        self.beta, self.most, self.digits = beta, most, digits
        # Arcs in the order of their edges' ids, forward first; equal ways are told apart by these ids, too.
        arcs = arcs.sort_by([("edge_id", "ascending"), ("ahead", "descending")])
        values = arcs["edge_id"].to_pylist()
        self.ids = sorted(set(values))
        rank = {x: i for i, x in enumerate(self.ids)}
        edge = np.array([rank[x] for x in values], np.int64)
        self.table, self.arc = arcs, np.unique(edge, return_index=True)[1]  # an arc of each edge
        nodes = pa.chunked_array([whole(arcs["source"]), whole(arcs["target"])]).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        source, target = np.split(nodes, 2)
        length, self.nodes = arcs["length"].to_numpy(), int(nodes.max(initial=0)) + 1
        self.arcs: dict = {}
        for u, v, size, e in zip(source.tolist(), target.tolist(), length.tolist(), edge.tolist(), strict=True):
            self.arcs.setdefault(u, []).append((v, size, e))
        self.ways: dict = {}
        lat, lon = (self.points.field(k).to_numpy() for k in ("lat", "lon"))
        point, arc, away, share = self.near(lon, lat, whole(arcs["line"]), reach)
        ahead = arcs["ahead"].to_numpy()[arc]
        kept, point = np.unique(point, return_inverse=True)
        lat, lon, self.ride = np.radians(lat[kept]), np.radians(lon[kept]), self.of[kept]
        self.new = np.append(True, self.ride[1:] != self.ride[:-1])[: len(self.ride)]  # the first points of rides
        self.size = np.bincount(point, minlength=len(kept))
        self.start = np.cumsum(self.size) - self.size
        share = np.round(share, SHARE_DIGITS)
        self.share = np.where(ahead, share, np.round(1 - share, SHARE_DIGITS))
        self.chance = -(away / sigma) * (away / sigma) / 2
        self.edge, self.turned, self.length = edge[arc], ~ahead, length[arc].astype(np.float64)
        self.source, self.target = source[arc], target[arc]
        self.crow = np.append(0.0, _apart(lat[:-1], lon[:-1], lat[1:], lon[1:]))

    @staticmethod
    def near(lon: np.ndarray, lat: np.ndarray, lines: pa.Array, reach: float) -> tuple[np.ndarray, ...]:
        """Points and arcs within reach of each other, their distance and the share of the line before the nearest place, in a flat projection at the point."""
        vertices, counts = lines.flatten(), lines.value_lengths().to_numpy()
        x, y = (vertices.field(k).to_numpy(zero_copy_only=False) for k in ("lon", "lat"))
        legs = counts - 1
        of = np.repeat(np.arange(len(counts)), legs)
        a = np.repeat(np.cumsum(counts) - counts, legs) + _within(legs)
        point, arc = _in_cells(lon, lat, [x[a], y[a], x[a + 1], y[a + 1]], of, reach)
        first, made = np.cumsum(legs) - legs, []
        sizes = np.cumsum(legs[arc])
        low = 0
        while low < len(point):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + MOVES)))
            p, e = point[low:high], arc[low:high]
            k = legs[e]
            at, q = a[np.repeat(first[e], k) + _within(k)], np.repeat(p, k)
            kx = np.cos(np.radians(lat[q])) * M_PER_DEGREE
            ax, ay, bx, by = (x[at] - lon[q]) * kx, (y[at] - lat[q]) * M_PER_DEGREE, (x[at + 1] - lon[q]) * kx, (y[at + 1] - lat[q]) * M_PER_DEGREE
            dx, dy = bx - ax, by - ay
            size = dx * dx + dy * dy
            t = np.where(size > 0, np.clip(-(ax * dx + ay * dy) / np.where(size > 0, size, 1), 0, 1), 0.0)
            away, long = np.hypot(ax + t * dx, ay + t * dy), np.sqrt(size)
            starts = np.cumsum(k) - k
            total = np.add.reduceat(long, starts)
            done = np.cumsum(long) - long
            best = _first_best(-away, starts)
            gone = done[best] - done[starts] + t[best] * long[best]
            share = np.where(total > 0, gone / np.where(total > 0, total, 1), 0.0)
            ok = away[best] <= reach
            made.append((p[ok], e[ok], away[best][ok], share[ok]))
            low = high
        return tuple(np.concatenate(v) for v in zip(*made, strict=True)) if made else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lengths of the ways between nodes, infinite beyond the limit."""
        codes, which = np.unique(a * self.nodes + b, return_inverse=True)
        pairs = list(zip((codes // self.nodes).tolist(), (codes % self.nodes).tolist(), strict=True))
        goals: dict = {}
        for pair in pairs:
            if pair not in self.ways:
                self.ways[pair] = (np.inf, None)
                goals.setdefault(pair[0], set()).add(pair[1])
        for start, ends in goals.items():
            for end, length, edges in _ways_from(self.arcs, start, ends, self.most):
                self.ways[start, end] = (length, edges)
        return np.array([self.ways[x][0] for x in pairs], np.float64)[which]

    def straight(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a ride goes on along one directed edge."""
        return (self.edge[a] == self.edge[b]) & (self.turned[a] == self.turned[b]) & (self.share[b] >= self.share[a])

    def moves(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates before and at these points, by the latter, and the scores of the moves between them (negatively infinite without a way)."""
        size = self.size[at - 1] * self.size[at]
        k = _within(size)
        before = np.repeat(self.size[at - 1], size)
        a, b = np.repeat(self.start[at - 1], size) + k % before, np.repeat(self.start[at], size) + k // before
        on = self.straight(a, b)
        ridden = (self.share[b] - self.share[a]) * self.length[b]
        x, y = a[~on], b[~on]
        ridden[~on] = (1 - self.share[x]) * self.length[x] + self.between(self.target[x], self.source[y]) + self.share[y] * self.length[y]
        return a, b, -np.abs(ridden / MICRO - np.repeat(self.crow[at], size)) / self.beta

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        """The chosen candidate of each point, and whether a piece begins there: at a ride's first point and wherever no move leads to."""
        n = len(self.size)
        place = _within(np.diff(np.append(np.flatnonzero(self.new), n)))
        order = np.argsort(place, kind="stable")
        ends = np.cumsum(np.bincount(place))
        score, back, begins = np.round(self.chance, self.digits), np.full(len(self.chance), -1), self.new.copy()
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            waiting = order[low:high]
            while len(waiting):
                sizes = np.cumsum(self.size[waiting - 1] * self.size[waiting])
                at, waiting = np.split(waiting, [max(1, int(np.searchsorted(sizes, MOVES)))])
                a, b, step = self.moves(at)
                total = np.round(score[a] + step + self.chance[b], self.digits)
                runs = np.append(True, b[1:] != b[:-1]).nonzero()[0]
                best = _first_best(total, runs)
                led = np.isfinite(total[best])
                ahead = np.maximum.reduceat(led, np.cumsum(self.size[at]) - self.size[at])
                begins[at[~ahead]] = True
                goes = np.repeat(ahead, self.size[at])
                score[b[runs[goes]]] = total[best[goes]]
                back[b[runs[goes]]] = a[best[goes]]
        pick = _first_best(score, self.start)
        for low, high in zip(ends[-2::-1], ends[:0:-1], strict=True):
            at = order[low:high]
            at = at[~begins[at]]
            pick[at - 1] = back[pick[at]]
        return pick, begins

    def edges(self) -> list[list[int]]:
        """The numbers of each ride's edges in order."""
        ridden: list = [[] for _ in range(self.rides)]
        if not len(self.ride):
            return ridden
        pick, begins = self.chosen()
        on = np.append(False, self.straight(pick[:-1], pick[1:])) & ~begins
        for k, (ride, first, same, edge) in enumerate(zip(self.ride.tolist(), begins.tolist(), on.tolist(), self.edge[pick].tolist(), strict=True)):
            now = ridden[ride]
            if not same:
                way = [] if first else self.ways[int(self.target[pick[k - 1]]), int(self.source[pick[k]])][1]
                for e in (*way, edge):
                    if not now or now[-1] != e:
                        now.append(e)
        return ridden

    def traversed(self, ride: np.ndarray, edge: np.ndarray, kind: pa.DataType) -> pa.StructArray:
        """Rides' edges in order as match_traversals has them."""
        arc = self.arc[edge]
        column = lambda k: self.table[k].combine_chunks()
        ends = pa.chunked_array([column("source"), column("target")]).combine_chunks().dictionary_encode().indices.to_numpy()
        a, b = ends[arc], ends[arc + self.table.num_rows]
        ahead = column("ahead").to_numpy(zero_copy_only=False)[arc]
        a, b = np.where(ahead, a, b), np.where(ahead, b, a)
        goes_on = ride[1:] == ride[:-1]
        after, before = np.append(goes_on, False), np.append(False, goes_on)
        nexts, lasts = [np.append(v[1:], -1) for v in (a, b)], [np.append(-1, v[:-1]) for v in (a, b)]
        holds = lambda ends, node: (ends[0] == node) | (ends[1] == node)
        turned = np.where(after, holds(nexts, a) & ~holds(nexts, b), before & holds(lasts, b) & ~holds(lasts, a))
        once = np.zeros(len(edge), bool)
        once[np.unique(np.stack([ride, edge]), axis=1, return_index=True)[1]] = True
        lines, line = column("line"), pa.array(arc)
        count = lines.value_lengths().to_numpy()
        middle = (np.cumsum(count) - count)[arc] + np.where(turned, count[arc] - 1 - count[arc] // 2, count[arc] // 2)
        x, y = (lines.flatten().field(k).to_numpy(zero_copy_only=False)[middle[once]] for k in ("lon", "lat"))
        place, point = near_points(ride[once], x, y, self.of, *(self.points.field(k).to_numpy() for k in ("lon", "lat")))
        sizes = np.zeros(len(edge), np.int64)
        sizes[once] = np.bincount(place, minlength=int(once.sum()))
        near = kind.field("near").type
        made = {"edge_id": column("edge_id").take(line), "metres": column("metres").take(line), "line": lines.take(line), "turned": pa.array(turned), "once": pa.array(once)}
        made["near"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), self.points.take(pa.array(point)).cast(near.value_type), type=near)
        return pa.StructArray.from_arrays([made[f.name].cast(f.type) for f in kind], fields=list(kind))


def _decoded(rides: DataFrame, edges: DataFrame, found: T.StructField, make: Callable[[Portion, np.ndarray, np.ndarray, pa.DataType], pa.Array], sigma: float, beta: float, reach: float, way_metres: float) -> DataFrame:
    """ride_id and what `make` finds of each ride, an array, from its portion; rides: ride_id and points, at least one."""
    placed = dealt(rides, way_metres, PORTION)
    arcs = arcs_around(placed, edges, reach, way_metres)
    schema = T.StructType([rides.schema["ride_id"], found])
    arrow, most, digits = to_arrow_schema(schema), int(round(way_metres * MICRO)), SCORE_DIGITS

    def decode(rides: pa.Table, arcs: pa.Table) -> pa.Table:
        if not rides.num_rows or not arcs.num_rows:
            return arrow.empty_table()
        portion = Portion(rides, arcs, sigma, beta, reach, most, digits)
        ridden, kind = portion.edges(), arrow.field(found.name).type
        sizes = np.array([len(x) for x in ridden])
        edge = np.array([e for x in ridden for e in x], np.int64)
        values = make(portion, np.repeat(np.arange(len(ridden)), sizes), edge, kind.value_type)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values, type=kind)
        some = pa.array(sizes > 0)
        return pa.table([rides["ride_id"].combine_chunks().filter(some), lists.filter(some)], schema=arrow)

    return placed.groupBy("tile", "portion").cogroup(arcs.groupBy("near_tile", "near_portion")).applyInArrow(decode, schema)


def match_rides(points: DataFrame, edges: DataFrame, sigma: float = SIGMA, beta: float = BETA, reach: float = REACH, way_metres: float = WAY_METRES) -> DataFrame:
    """ride_id and edge_ids (ordered) of rides of GPS points (ride_id, lat, lon, ts), by the likeliest way over the network.

    Points are ordered by ts, then lat and lon. Points without an edge in reach are left out; where no way of at most
    way_metres leads on, the match goes on with a new piece. A ride without any edge in reach has no edges. Repeated edges that follow each other count once.
    """
    ready_to_checkpoint(points.sparkSession)
    ids = T.ArrayType(edges.schema["edge_id"].dataType)
    numbers = lambda portion, _, edge, kind: pa.array([portion.ids[e] for e in edge.tolist()], kind)
    rides = ride_rows(points).where("ride_id is not null and size(points) > 0")
    joined = _decoded(rides, edges, T.StructField("edge_ids", ids), numbers, sigma, beta, reach, way_metres)
    return points.select("ride_id").distinct().join(joined, "ride_id", "left").select("ride_id", F.coalesce("edge_ids", F.array().cast(ids)).alias("edge_ids"))


def match_traversals(rides: DataFrame, edges: DataFrame, sigma: float = SIGMA, beta: float = BETA, reach: float = REACH, way_metres: float = WAY_METRES) -> DataFrame:
    """ride_id and traversals (edge_id, metres, line, turned, once and near, ordered) of the rides that match an edge, as match_rides matches them.

    rides: ride_id and points (see ride_rows), at least one. turned: whether the edge is ridden against its line, by the edges beside it; once: whether it is the
    edge's first ride; then near has the ride's points that may be the nearest to the middle vertex of the line as ridden: all that are, to the micrometre, and few others.
    """
    kinds = edges.schema
    fields = [T.StructField(k, kinds[k].dataType) for k in ("edge_id", "metres", "line")] + [T.StructField(k, T.BooleanType()) for k in ("turned", "once")]
    found = T.StructField("traversals", T.ArrayType(T.StructType([*fields, T.StructField("near", rides.schema["points"].dataType)])))
    return _decoded(rides, edges, found, lambda portion, ride, edge, kind: portion.traversed(ride, edge, kind), sigma, beta, reach, way_metres)
