"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed: each pass over the table computes Xᵀ(XQ) of centred rows X for a block Q of
directions, summed in each task to one small matrix and added up by Spark. QR makes the next block orthonormal, Rayleigh-Ritz
turns it to the best estimates of eigenvectors, and passes go on until the residuals |Vu - eu| certify all
components to double precision (TOLERANCE of the largest eigenvalue). The block has OVERSAMPLE directions more than components
are asked for; when the decay of residuals promises more than PATIENCE further passes, it is widened by random directions, up to all
dimensions, for then the eigenvalues beside the block are too near those in it.

Vectors are taken as integers x = floor(SCALE * entry) + SHIFT, so their sums are exact, and rows are centred as
(n*x - S) / n before anything is multiplied.

Rows whose vector is null or holds null or non-finite entries are dropped, and those of another length than the most
frequent one (the longest of several) too. Repeated rows and equal or null vec_ids count and return each. Entries that
a long can't hold scaled are clipped to +-LIMIT. Components without variance (eigenvalues below RANK of the largest) can't be whitened
and aren't returned, so equal vectors, a single one or an empty table give no rows. A deviation that a long can't hold is null. Components of equal
eigenvalues are any basis of their space, the same for all rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ensure_checkpoints, table

c = F.col
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 52
COMPONENTS, OVERSAMPLE, PATIENCE, PASSES = 32, 16, 12, 500
#: Residual of a certified component and least eigenvalue, as shares of the largest eigenvalue.
TOLERANCE, RANK = 1e-14, 1e-12
#: Rows multiplied at once.
ROWS = 4096


@dataclass
class Whitening:
    """n rows of sums per dimension; components as rows with eigenvalues by fall; trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    residuals: np.ndarray


def scaled(vectors: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """keep's columns and x, the integers of all vectors that are whole and of the most frequent length."""
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    whole = vectors.select(*keep, c(vector).cast("array<double>").alias("__v")).where(c("__v").isNotNull() & F.forall("__v", finite))
    sizes = whole.groupBy(F.size("__v").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    clip = lambda e: F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(e * SCALE).cast("double"))).cast("long") + SHIFT
    return whole.where(F.size("__v") == d).select(*keep, F.transform("__v", clip).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, from the exact n*x - S where a long holds it."""
    s = np.array(sums, dtype=object)
    mean = s // n
    rest = np.array([int(v) for v in s - mean * n], np.float64) / n
    return (x - np.array([int(m) for m in mean], np.int64)).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n*x - S)^2 of each row, exact; null beyond a long."""
    most = max((abs(n * int(e) - s) for e in (x.min(initial=0), x.max(initial=0)) for s in sums), default=0)
    if most * most * max(1, x.shape[1]) < 1 << 63:
        z = n * x - np.array(sums, np.int64)
        return (z * z).sum(axis=1).tolist()
    exact = (sum((n * int(e) - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def summed(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of a function of blocks of x: one array of fixed size from each task, added up by dimension."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = _matrix(batch.column(0))
            for lo in range(0, len(x), ROWS):
                total += work(x[lo : lo + ROWS]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    parts = rows.select("x").mapInArrow(run, "i int, v double")
    out = np.zeros(size)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(shape)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many rows there are, and the exact sum of each dimension."""
    n = rows.count()
    total = rows.select(F.posexplode("x").alias("i", "e")).groupBy("i").agg(F.sum(c("e").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r["i"]: int(r["s"]) for r in total}
    return n, [sums[i] for i in range(len(sums))]


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, seed: int = 7) -> Whitening:
    """Certified leading components of rows (x); rows should be checkpointed, as each pass reads them."""
    n, sums = exact_sums(rows)
    d = len(sums)
    none = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), 0.0, 0, np.zeros(0))
    if not n or not d:
        return none
    k, rng = min(components, d), np.random.default_rng(seed)
    b = min(d, k + OVERSAMPLE)
    q = np.linalg.qr(rng.standard_normal((d, b)))[0]
    trace, before = 0.0, None
    for turn in range(1, PASSES + 1):

        def product(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            z = centred(x, n, sums)
            return np.concatenate([z.T @ (z @ q), (z * z).sum(axis=0)[:, None]], axis=1)

        made = summed(rows, product, (d, b + 1)) / n
        y, trace = made[:, :-1], float(made[:, -1].sum())
        if not trace:
            return none
        # Rayleigh-Ritz in the block: eigenvectors of QᵀVQ.
        h = q.T @ y
        values, turns = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)
        values, turns = values[order], turns[:, order]
        vectors, images = q @ turns, y @ turns
        residuals = np.linalg.norm(images - vectors * values, axis=0)[:k]
        wanted = values[:k] > RANK * values[0]
        goal = max(TOLERANCE, 4 * d * np.finfo(float).eps) * values[0]
        worst = float(residuals[wanted].max())
        if worst <= goal or b == d and turn > 2 and before is not None and worst >= before / 2 and worst <= 1e3 * goal:
            return Whitening(n, sums, vectors[:, :k][:, wanted].T.copy(), values[:k][wanted], trace, turn, residuals[wanted])
        q = np.linalg.qr(images)[0]
        if b < d and before is not None:
            rate = worst / before
            left = np.log(goal / worst) / np.log(rate) if rate < 1 else np.inf
            if left > PATIENCE:
                wider = min(d, 2 * b)
                q = np.linalg.qr(np.concatenate([q, rng.standard_normal((d, wider - b))], axis=1))[0]
                b, before = wider, None
                continue
        before = worst
    raise RuntimeError(f"{PASSES} passes left a residual of {worst:.3g}, more than {goal:.3g}")


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened rows: centred, projected on the components, divided by the root of their eigenvalues."""
    return centred(x, model.n, model.sums) @ model.components.T / np.sqrt(model.values)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured over all rows."""
    k = len(model.values)

    def products(x: np.ndarray) -> np.ndarray:
        w = projected(x, model)
        return np.concatenate([w.T @ w, w.sum(axis=0)[:, None]], axis=1)

    made = summed(rows, products, (k, k + 1)) / model.n
    mean = made[:, -1]
    return float(np.abs(made[:, :-1] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """key, deviation and whitened (array of a value for each component) of each row."""
    schema = T.StructType([rows.schema[key], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            w = projected(x, model)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x, model.n, model.sums), pa.int64()), lists], schema=arrow)

    return rows.select(key, "x").mapInArrow(run, schema)


def whitened_components(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector (vec_id, embedding) and component: n, deviation, whitened, explained and identity_error."""
    ensure_checkpoints(vectors.sparkSession)
    rows = scaled(vectors).checkpoint()
    model = fit_whitening(rows, components)
    out = "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    if not len(model.values):
        return rows.limit(0).select("vec_id", F.lit(0).alias("component"), *(F.lit(0).cast("long").alias(k) for k in out[2:4]), *(F.lit(0.0).alias(k) for k in out[4:]))
    error = identity_error(rows, model)
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select("vec_id", (c("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[c("i")].alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
