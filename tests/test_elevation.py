import math
import random
import struct

import pytest

from kerbline.sources import elevation as E


def tile(heights):
    return b"".join(struct.pack(">h", h) for row in heights for h in row)


def bilinear(tiles, lon, lat):
    s, w = math.floor(lat), math.floor(lon)
    if (s, w) not in tiles:
        return None
    h = tiles[s, w]
    n = len(h)
    y, x = (s + 1 - lat) * (n - 1), (lon - w) * (n - 1)
    i, j = min(math.floor(y), n - 2), min(math.floor(x), n - 2)
    got = [(h[i + a][j + b], (y - i if a else 1 - y + i) * (x - j if b else 1 - x + j)) for a in (0, 1) for b in (0, 1)]
    got = [(v, k) for v, k in got if v != E.VOID]
    total = sum(k for _, k in got)
    return sum(v * k for v, k in got) / total if total > 0 else None


@pytest.mark.parametrize(("n", "block"), [(2, 64), (65, 64), (66, 64), (30, 7), (29, 7), (130, 64)])
def test_heights_between_samples(spark, tmp_path, monkeypatch, n, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rnd = random.Random(n)
    tiles = {}
    for name, at in (("N52E013", (52, 13)), ("S01W002", (-1, -2)), ("N52E014", (52, 14))):
        tiles[at] = [[E.VOID if rnd.random() < 0.15 else rnd.randint(-400, 8000) for _ in range(n)] for _ in range(n)]
        (tmp_path / f"{name}.hgt").write_bytes(tile(tiles[at]))
    (tmp_path / "N10E010.hgt").write_bytes(b"odd")
    (tmp_path / "notes.txt").write_bytes(b"no tile")
    (tmp_path / "wrong.hgt").write_bytes(tile([[1, 2], [3, 4]]))
    places = [(k, w + rnd.random(), s + rnd.random()) for k, (s, w) in enumerate(list(tiles) * 40)] + [(900, 13.0, 52.0), (901, 14.0, 52.5), (902, 13.5, 52.0), (903, 13.0, 53.0), (904, 5.0, 5.0), (905, None, 52.5)]
    blocks = E.blocks(E.read_tiles(spark, str(tmp_path)))
    got = {r.node: r.elevation for r in E.elevations(spark.createDataFrame(places, "node int, lon double, lat double"), blocks).collect()}
    assert len(got) == len(places) and got[904] is None and got[905] is None and got[903] is None
    for k, lon, lat in places[:-1]:
        want = bilinear(tiles, lon, lat)
        assert (got[k] is None) == (want is None) and (want is None or math.isclose(got[k], want, rel_tol=1e-9, abs_tol=1e-6)), k


def test_gradients_by_hand(spark, tmp_path):
    # Heights rise by 60 m from west to east over a degree, so by 0.6 m over a hundredth.
    (tmp_path / "N52E013.hgt").write_bytes(tile([[0, 30, 60]] * 3))
    line = lambda *p: [{"lon": x, "lat": y} for x, y in p]
    rows = [(1, 100.0, line((13.2, 52.5), (13.3, 52.1), (13.21, 52.5))), (2, 100.0, line((13.21, 52.5), (13.2, 52.5))), (3, 0.5, line((13.2, 52.5), (13.7, 52.5))), (4, 100.0, line((13.2, 52.5), (20.0, 52.5))), (5, 100.0, None)]
    edges = spark.createDataFrame(rows, "edge_id int, metres double, line array<struct<lon:double,lat:double>>")
    got = {r.edge_id: r.gradient_percent for r in E.with_gradients(edges, E.blocks(E.read_tiles(spark, str(tmp_path)))).collect()}
    assert math.isclose(got[1], 0.6, rel_tol=1e-9) and math.isclose(got[2], -0.6, rel_tol=1e-9)
    assert got[3] == 0.0 and got[4] is None and got[5] is None
