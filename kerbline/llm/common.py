"""What the text operators share: reading tables, Arrow row loops, folds, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.components import ready_to_checkpoint as ensure_checkpoints  # noqa: F401

#: Characters of text handled at once inside a Python worker.
CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Only Spark's reader opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null keys fall in no fold (null)."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.crc32(key.cast("string").cast("binary")) % folds).cast("int")


def in_fold(key: str | Column, folds: int, which: int) -> Column:
    """True where the key is in that fold; false for null keys."""
    return F.coalesce(fold(key, folds) == which, F.lit(False))


def few_of(df: DataFrame, order: Column, wanted: int, total: int) -> DataFrame:
    """Rows whose hash is among the smallest, about four times as many as wanted: a sort and limit over them sends few rows from each task.

    order: a 64-bit hash; total: about how many rows df has.
    """
    share = 4 * max(wanted, 250) / max(total, 1)
    return df if share >= 1 else df.where(order <= F.lit(int(-(2**63) + share * 2**64)))


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of at most so many rows that hold about `limit` characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit or i + 1 - start >= rows:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def spans(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """The same over an Arrow column, by bytes, without turning it into Python strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit)) + 1)
        yield start, min(end, len(ends))
        start = end


def map_texts(
    df: DataFrame,
    text: str,
    schema: T.StructType,
    make: Callable[[], Callable[[list[str]], Iterable[list]]],
    keep: list[str],
    limit: int = CHUNK_CHARS,
) -> DataFrame:
    """Adds columns computed from one text column, chunk by chunk, over Arrow batches.

    make() runs once in each task and returns a function from a list of texts (null: empty)
    to a list of columns in the order of `schema`. Rows, their order and `keep` stay.
    """
    source = df.select(*keep, F.col(text).alias("__text"))
    out = T.StructType([*source.select(*keep).schema.fields, *schema.fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(len(keep))
            for lo, hi in spans(texts, limit):
                made = work([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                new = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, list(arrow)[len(keep) :], strict=True)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip([*kept, *new], arrow, strict=True)], schema=arrow)

    return source.mapInArrow(run, out)
