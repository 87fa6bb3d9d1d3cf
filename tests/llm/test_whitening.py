import math

import numpy as np
import pytest

from kerbline.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, matrix):
    return spark.createDataFrame([(i, [float(e) for e in row], 0) for i, row in enumerate(matrix)], SCHEMA).repartition(3)


def truth(matrix):
    """x, eigenvalues by fall and eigenvectors as rows, by numpy's whole decomposition."""
    x = np.floor(64 * np.asarray(matrix, np.float32).astype(np.float64)) + 1_000_000
    z = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(z.T @ z / len(x))
    return x, values[::-1], vectors[:, ::-1].T


def by_component(rows):
    out = {}
    for r in rows:
        out.setdefault(r.component, {})[r.vec_id] = r
    return out


def check(spark, matrix, rows, components, near=1e-6):
    x, values, vectors = truth(matrix)
    n, got = len(x), by_component(rows)
    assert sorted(got) == list(range(1, components + 1))
    z = x - x.mean(axis=0)
    exact = [[n * int(e) for e in row] for row in x]
    sums = [sum(int(e) for e in col) for col in x.T]
    want = [sum((e - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in exact]
    w = np.array([[got[k][i].whitened for k in sorted(got)] for i in range(n)])
    for k in range(components):
        assert math.isclose(got[k + 1][0].explained, values[k] / values.sum(), rel_tol=1e-9)
        mine = z @ vectors[k] / math.sqrt(values[k])
        assert min(np.abs(w[:, k] - mine).max(), np.abs(w[:, k] + mine).max()) < near
        assert [got[k + 1][i].deviation for i in range(n)] == want and got[k + 1][0].n == n
    error = np.abs(np.cov(w.T, bias=True).reshape(components, components) - np.eye(components)).max()
    assert got[1][0].identity_error < 1e-9 and abs(error - got[1][0].identity_error) < 1e-9


def test_table(spark, sf_dir):
    table = sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    assert [r.vec_id for r in table] == list(range(len(table)))
    check(spark, [r.embedding for r in table], wh.op11_whitening(spark, sf_dir).collect(), 32)


@pytest.mark.parametrize("scales", [2.0 ** -np.arange(40), 1 / (1 + np.arange(40)), np.r_[np.full(4, 30.0), np.ones(36)]])
def test_narrow_blocks(spark, monkeypatch, scales):
    monkeypatch.setattr(wh, "OVERSAMPLE", 3)
    matrix = np.random.default_rng(1).standard_normal((300, 40)) * scales * 20
    made = wh.fit_whitening(wh.scaled(frame(spark, matrix)), 4)
    values = truth(matrix)[1]
    assert np.allclose(made.values, values[:4], rtol=1e-10) and made.passes > 1
    assert (made.residuals <= 1e-13 * values[0]).all()
    check(spark, matrix, wh.whitened_components(frame(spark, matrix), 4).collect(), 4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [], 1), (6, [1.0, 2.0, 3.0], 1), (7, [-0.5, 1.0], 1), (7, [-0.5, 1.0], 1), (None, [0.0, 0.01], 1), (8, [3.0, -1.0], None)]
    got = wh.whitened_components(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as x", "2 as component", "3 as n")).collect()
    assert sorted({r.vec_id for r in got}, key=str) == [0, 7, 8, None] and len(got) == 10
    assert {r.component for r in got} == {1, 2} and {r.n for r in got} == {5}
    assert got[0].identity_error < 1e-12 and math.isclose(sum({r.component: r.explained for r in got}.values()), 1)


def test_little_variance(spark):
    for rows in ([], [(1, [1.0, 2.0], 1)], [(i, [1.0, 2.0], 1) for i in range(5)], [(1, [], 1)], [(1, None, 1)]):
        df = wh.whitened_components(spark.createDataFrame(rows, SCHEMA))
        assert df.count() == 0 and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # A dimension that repeats another adds no component.
    matrix = np.random.default_rng(2).integers(-50, 50, (60, 3)) / 64
    got = wh.whitened_components(frame(spark, np.c_[matrix, matrix[:, 0], matrix[:, 1] + 1]))
    assert {r.component for r in got.collect()} == {1, 2, 3} and got.first().identity_error < 1e-9


def test_large_entries(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [-1e30, 2.0], 1), (2, [3.0, 5.0], 1)]
    got = wh.whitened_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.deviation for r in got if r.vec_id == 0} == {None} and all(math.isfinite(r.whitened) for r in got)
    for most in (2**20, 2**29, 2**40):
        x, sums = np.array([[most, -most], [5, 7], [0, 0]]), [most + 5, 7 - most]
        want = [sum((3 * e - s) ** 2 for e, s in zip(r, sums, strict=True)) for r in x.tolist()]
        assert wh.deviations(x, 3, sums) == [v if v < 2**63 else None for v in want]
