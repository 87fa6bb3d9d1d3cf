import math

import duckdb
import pytest

from kerbline.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.execute(ORACLES[name])
    types = {d[0]: r[1] for d, r in zip(want.description, duck.execute(f"DESCRIBE {ORACLES[name]}").fetchall(), strict=True)}
    assert {n: TYPES.get(t, t) for n, t in df.dtypes} == types
    names = list(types)
    rows = [dict(zip(names, r, strict=True)) for r in duck.execute(ORACLES[name]).fetchall()]
    got = sorted(tuple(plain(r[k]) for k in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[k]) for k in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_ride_is_routed(spark, sf_dir):
    import numpy as np

    from kerbline.operators import graph
    from kerbline.plans.adapters import Ride
    from kerbline.plans.catalog import _network

    r = Ride(spark, sf_dir)
    ways = [(w.source, w.target, w.metres, w.edge_id) for w in graph.directed(_network(r)).collect()]
    n, top = r.table("part").count(), max(max(w[:2]) for w in ways)
    least = np.full((top + 1, top + 1), np.inf)
    np.fill_diagonal(least, 0)
    for a, b, w, _ in ways:
        least[a, b] = min(least[a, b], w)
    for k in range(top + 1):
        least = np.minimum(least, least[:, k, None] + least[k])
    step = {(a, e): (b, w) for a, b, w, e in ways}
    rows = {x.ride_id: x for x in QUERIES["gr1_shortest_paths"](spark, sf_dir).collect()}
    assert sorted(rows) == sorted(x.o_orderkey for x in r.table("orders").collect())
    for ride, x in rows.items():
        at, goal = ride % n + 1, ride * 7 % n + 1
        want, gone = least[at, goal], 0.0
        assert x.shortest_distance == (want if np.isfinite(want) else None)
        for e in filter(None, (x.path_edges or "").split(",")):
            at, w = step[at, int(e)]
            gone += w
        assert x.shortest_distance is None or (at, gone) == (goal, want)
    assert any(x.shortest_distance is not None for x in rows.values())


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_corridor_plan_stays_small(spark, sf_dir):
    plan = QUERIES["tk1_suspicious"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = QUERIES["wn1_calibration_sample"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    for name in ("jn5_incidents_near", "jn6_detector_ranks", "jn10_closures"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
