"""Map matching against exhaustive search, the bound of its index, and breaks."""

import itertools
import math
import random

import numpy as np
import pytest

from kerbline.functions import geo as G
from kerbline.operators import matching as M

EDGES = "edge_id long, from_node long, to_node long, metres double, forward boolean, backward boolean, line array<struct<lon:double,lat:double>>"
POINTS = "ride_id string, lat double, lon double, ts long"
WIDE = 6


def metres(a, b):
    (lon1, lat1), (lon2, lat2) = a, b
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * G.EARTH_M * math.asin(math.sqrt(h))


def grid(wide=WIDE, high=5, seed=1):
    """Streets of about 100 m with bends and one-way streets."""
    rnd = random.Random(seed)
    at = {(x, y): (13.4 + x * 0.0015 + rnd.uniform(-2e-4, 2e-4), 52.5 + y * 0.0009 + rnd.uniform(-1e-4, 1e-4)) for x in range(wide) for y in range(high)}
    rows = []
    for (x, y), p in at.items():
        for near in ((x + 1, y), (x, y + 1)):
            if near in at:
                q = at[near]
                line = [p, ((p[0] + q[0]) / 2 + rnd.uniform(-1e-4, 1e-4), (p[1] + q[1]) / 2 + rnd.uniform(-1e-4, 1e-4)), q]
                rows.append((len(rows) + 1, x + wide * y, near[0] + wide * near[1], sum(metres(a, b) for a, b in itertools.pairwise(line)), True, rnd.random() > 0.3, line))
    return rows


def position(lon, lat, line):
    kx = math.cos(math.radians(lat)) * G.M_PER_DEGREE
    flat = [((x - lon) * kx, (y - lat) * G.M_PER_DEGREE) for x, y in line]
    best, done = None, 0.0
    for (ax, ay), (bx, by) in itertools.pairwise(flat):
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        t = max(0.0, min(1.0, -(ax * dx + ay * dy) / size)) if size else 0.0
        away = math.hypot(ax + t * dx, ay + t * dy)
        if best is None or away < best[0]:
            best = (away, done + t * math.sqrt(size))
        done += math.sqrt(size)
    return best[0], best[1] / done if done else 0.0


def all_ways(rows, most):
    """The shortest way of every pair of nodes by length and edges, by relaxing until nothing changes."""
    arcs = [(u, v, round(m * 1e6), e) for e, u, v, m, f, b, _ in rows if f] + [(v, u, round(m * 1e6), e) for e, u, v, m, f, b, _ in rows if b]
    nodes = {n for a in arcs for n in a[:2]}
    best = {(n, n): (0, ()) for n in nodes}
    changed = True
    while changed:
        changed = False
        for (s, u), (length, path) in list(best.items()):
            for a, b, size, e in arcs:
                new = (length + size, (*path, e))
                if a == u and new[0] <= most and new < best.get((s, b), (math.inf,)):
                    best[s, b], changed = new, True
    return best


def exhaustive(points, rows, ways, reach):
    """The best of all sequences of candidates of one ride without breaks: score and edges."""
    cands = []
    for lat, lon in points:
        own = []
        for e, u, v, m, f, b, line in rows:
            away, share = position(lon, lat, line)
            if away <= reach:
                own += [(e, True, u, v, m, away, share)] * f + [(e, False, v, u, m, away, 1 - share)] * b
        if own:
            cands.append(((lon, lat), own))
    found = []
    for seq in itertools.product(*(own for _, own in cands)):
        score, path = sum(-((x[5] / M.SIGMA) ** 2) / 2 for x in seq), [seq[0][0]]
        for k in range(1, len(seq)):
            a, b = seq[k - 1], seq[k]
            if a[:2] == b[:2] and b[6] >= a[6]:
                way = (b[6] - a[6]) * b[4]
            elif (a[3], b[2]) in ways:
                length, edges = ways[a[3], b[2]]
                way = (1 - a[6]) * a[4] + length / 1e6 + b[6] * b[4]
                path += [*edges, b[0]]
            else:
                break
            score -= abs(way - metres(cands[k - 1][0], cands[k][0])) / M.BETA
        else:
            found.append((score, [e for i, e in enumerate(path) if not i or path[i - 1] != e]))
    return max(found, key=lambda x: x[0]) if found else None


def frame(spark, rows):
    return spark.createDataFrame([(*r[:6], [{"lon": x, "lat": y} for x, y in r[6]]) for r in rows], EDGES)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_exhaustive_search(spark, seed):
    rows, rnd = grid(seed=seed), random.Random(seed)
    places = {n: p for r in rows for n, p in ((r[1], r[6][0]), (r[2], r[6][-1]))}
    rides = {}
    for k in range(25):
        at = rnd.choice(sorted(places))
        points = []
        for _ in range(rnd.randint(1, 5)):
            r = rnd.choice([r for r in rows if at in r[1:3]])
            t = rnd.random()
            (ax, ay), (bx, by) = r[6][0], r[6][-1]
            points.append((ay + t * (by - ay) + rnd.uniform(-1e-4, 1e-4), ax + t * (bx - ax) + rnd.uniform(-1e-4, 1e-4)))
            at = r[2] if at == r[1] else r[1]
        rides[f"r{k}"] = points
    reach, most = 40.0, 400.0
    ways = all_ways(rows, round(most * 1e6))
    df = spark.createDataFrame([(r, *p, k) for r, ps in rides.items() for k, p in enumerate(ps)], POINTS)
    got = {r.ride_id: r.edge_ids for r in M.match_rides(df.repartition(3), frame(spark, rows), reach=reach, way_metres=most).collect()}
    checked = 0
    for ride, points in rides.items():
        want = exhaustive(points, rows, ways, reach)
        if want:
            assert got[ride] == want[1], ride
            checked += len(points) > 2
    assert checked > 5 and set(got) == set(rides)


def test_ways_are_bounded_and_shortest(spark):
    rows = grid()
    nodes = sorted({n for r in rows for n in r[1:3]})
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "source long, target long")
    got = {(r.source, r.target): (r.length, tuple(r.edges)) for r in M.bounded_ways(pairs.union(pairs), frame(spark, rows), 250.0).collect()}
    assert got == all_ways(rows, 250_000_000) and len(got) < len(nodes) ** 2


def test_points_meet_the_edges_of_their_cells_only(spark):
    """Twice as wide a network doesn't add to what a point meets."""
    points = spark.createDataFrame([("r", k, 52.5 + k * 0.0009, 13.4 + k * 0.0015) for k in range(4)], "ride_id string, n int, lat double, lon double")
    counts = [M.candidates(points, frame(spark, grid(wide, 5)).where("true")).count() for wide in (6, 12)]
    plan = M.candidates(points, frame(spark, grid(6, 5)))._jdf.queryExecution().toString()
    assert counts[0] > 0 and counts[1] <= counts[0] + 8 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_breaks_and_odd_points(spark):
    line = lambda *p: [{"lon": x, "lat": y} for x, y in p]
    rows = [(1, 1, 2, 100.0, True, False, line((13.4, 52.5), (13.4015, 52.5))), (2, 8, 9, 100.0, True, True, line((13.42, 52.5), (13.4215, 52.5))), (3, 2, 3, 1.0, True, True, line((1.0, 1.0)))]
    edges = spark.createDataFrame(rows, EDGES)
    points = [("a", 52.5, 13.4003, 1), ("a", 52.5, 13.4012, 2), ("a", 52.5, 13.4205, 3), ("a", None, 13.4, 4), ("a", 52.5, 13.4208, 4), ("a", 40.0, 1.0, 5), ("b", 40.0, 1.0, 1), ("c", 52.5, 13.4012, 1), ("c", 52.5, 13.4003, 2), ("d", 52.5, 13.4003, 7), ("d", 52.5, 13.4003, 7), ("e", None, None, None)]
    got = {r.ride_id: r.edge_ids for r in M.match_rides(spark.createDataFrame(points, POINTS), edges).collect()}
    # a: no way leads to the second edge, so a new piece begins. c: against the only direction, so both points are pieces of one edge.
    assert got == {"a": [1, 2], "b": [], "c": [1], "d": [1], "e": []}
    assert M.match_rides(spark.createDataFrame([], POINTS), edges).count() == 0


def test_nearest_in_group(spark):
    from kerbline.operators.spatial import nearest_in_group

    rnd = random.Random(4)
    places, points = [], []
    for g in range(6):
        spread = 10.0 ** -rnd.randint(0, 4)
        points += [(g, k, 52.5 + rnd.uniform(-1, 1) * spread, 13.4 + rnd.uniform(-1, 1) * spread, k * 7) for k in range(rnd.randint(0, 40) if g else 0)]
        places += [(g, k, 52.5 + rnd.uniform(-1, 1) * spread * 3, 13.4 + rnd.uniform(-1, 1) * spread * 3) for k in range(20)]
    points += [(3, 100 + k, 52.6, 13.5, k) for k in range(5)]
    places += [(3, 50, 52.6, 13.5), (4, 51, 48.0, 2.0)]
    a = spark.createDataFrame(places, "g int, k int, lat double, lon double")
    b = spark.createDataFrame(points, "g int, seq int, lat double, lon double, ts int")
    got = {(r.g, r.k): r.ts for r in nearest_in_group(a, b, "g", "k", "ts", "seq").collect()}
    want = {}
    for g, k, lat, lon in places:
        own = [(round(metres((lon, lat), (q[3], q[2])), 6), q[1], q[4]) for q in points if q[0] == g]
        if own:
            want[g, k] = min(own)[2]
    assert got == want


def test_portions_and_moves_change_nothing(spark, monkeypatch):
    """Rides dealt in small portions, their moves scored a few at a time, match as in one portion; no candidate or move is a row of its own."""
    rows, rnd = grid(12, 9), random.Random(5)
    points = [(f"r{k % 20}", 52.5 + rnd.random() * 0.008, 13.4 + rnd.random() * 0.016, k) for k in range(160)]
    points += [(f"s{k}", 52.5 + t * 0.0009, 13.4 + k * 0.0015 + 0.0001, t) for k in range(5) for t in range(6)]
    df, edges = spark.createDataFrame(points, POINTS), frame(spark, rows)
    matched = lambda: {r.ride_id: r.edge_ids for r in M.match_rides(df, edges).collect()}
    whole = matched()
    plan = M.match_rides(df, edges)._jdf.queryExecution().toString()
    assert "posexplode" not in plan and len(whole) == 25 and all(whole[f"s{k}"] for k in range(5))
    monkeypatch.setattr(M, "MOVES", 7)
    monkeypatch.setattr(M, "PORTION", 10)
    parts = M.portions(df, M.WAY_METRES, 10).select("tile", "portion").distinct().count()
    assert parts > 5 and matched() == whole


def test_pending_rides_in_small_portions(spark, monkeypatch):
    """Pending rides matched in small portions are those matched in one."""
    from kerbline.operators.rides import match_pending

    rows, rnd = grid(12, 9), random.Random(6)
    points = [(f"r{k}", t, 52.5 + (k % 8) * 0.0009 + rnd.uniform(-1e-4, 1e-4), 13.4 + t * 0.0015 + 0.0007, t * 1000 + 1) for k in range(12) for t in range(9)]
    df, edges = spark.createDataFrame(points, "ride_id string, seq long, lat double, lon double, ts long"), frame(spark, rows)
    done = lambda: sorted((r.ride_id, r.status, r.edge_ids, [tuple(x) for x in r.traversals]) for r in match_pending(df, edges).collect())
    whole = done()
    monkeypatch.setattr(M, "PORTION", 20)
    assert len(whole) == 12 and done() == whole


@pytest.mark.parametrize("moves", [7, 1_000_000])
def test_near_points_hold_the_nearest(monkeypatch, moves):
    monkeypatch.setattr(M, "MOVES", moves)
    rng = np.random.default_rng(3)
    spread = 10.0 ** -rng.integers(0, 5, 300)
    of, x, y = rng.integers(0, 6, 300), 13.4 + rng.uniform(-1, 1, 300) * spread, 52.5 + rng.uniform(-1, 1, 300) * spread
    of, x, y = np.append(of, of[:40]), np.append(x, x[:40]), np.append(y, y[:40])  # points that are as near as others
    at, lon, lat = rng.integers(0, 7, 80), 13.4 + rng.uniform(-2, 2, 80) * spread[:80], 52.5 + rng.uniform(-2, 2, 80) * spread[:80]
    at, lon, lat = np.append(at, of[:40]), np.append(lon, x[:40]), np.append(lat, y[:40])
    place, point = M.near_points(at, lon, lat, of, x, y)
    assert (np.diff(place) >= 0).all()
    for k in range(len(at)):
        away = {i: metres((lon[k], lat[k]), (x[i], y[i])) for i in np.flatnonzero(of == at[k]).tolist()}
        near = {i for i in away if away[i] <= min(away.values()) + 1e-6}
        found = point[place == k].tolist()
        assert near <= set(found) and len(set(found)) == len(found) and all(away[i] <= min(away.values()) + 2e-5 for i in found)
    assert all(len(v) == 0 for v in M.near_points(at[:0], lon[:0], lat[:0], of, x, y))


def test_pending_rides_are_rows_of_rides(spark):
    """Neither ridden edges nor single points are rows after the rides are gathered."""
    from kerbline.operators.rides import match_pending

    points = [("a", k, 52.5, 13.4 + 0.0007 * k, k) for k in range(12)]
    done = match_pending(spark.createDataFrame(points, "ride_id string, seq long, lat double, lon double, ts long"), frame(spark, grid(12, 9)))
    plan = done._jdf.queryExecution().toString()
    assert "posexplode" not in plan and "Window" not in plan and "seq" in plan
    assert [r.ride_id for r in done.collect()] == ["a"]


def test_joins_around_the_network_are_sorted(spark):
    """The network is never broadcast, however small Spark takes it to be; only crowded tiles are."""
    placed = M.portions(spark.createDataFrame([("a", 52.5, 13.4, 1)], POINTS), M.WAY_METRES)
    plan = M.arcs_around(placed, frame(spark, grid()).where("edge_id < 5"), M.REACH, M.WAY_METRES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 5 and plan.count("BroadcastHashJoin") == 2  # placed is read twice
