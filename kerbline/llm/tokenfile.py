"""Token-ID files: documents encoded to ids, stored in ascending doc_id order, compressed shard by shard by Re-Pair.

Texts are cut at spaces between two visible characters, where the byte-level pattern always cuts
too; the tokenizers library encodes each distinct run of a chunk once, and a document's ids are its runs' ids
in order and the end id. Rows are dealt to ranges of doc_id (quantiles of the ids alone are computed first) and sorted
there, so the ranges in order hold all documents in order.

A range is cut into shards of whole documents of about SHARD ids. In a shard, frequent pairs of neighbours are
replaced by new symbols, round by round, until no pair is frequent or symbols no longer fit their width;
no pair crosses documents. The file format is a Parquet folder with a row for each shard:

* part, shard: the range and the shard's place in it; first_doc, last_doc; n_docs, n_tokens
* base: the number of plain ids; symbols below it are ids, the others are rules from base on
* width: bytes of a symbol, 2 or 4; all numbers are little-endian and unsigned
* rules: left and right symbol of each rule, of which both are older than the rule
* lengths: how many ids each rule stands for, 4 bytes each
* symbols: the documents' symbols, one after another
* doc_ids (null: no id), doc_symbols and doc_tokens: for each document how many symbols and ids it has

A document's ids are found from doc_symbols, and any id within it from the lengths, without expanding what
stands before (read_range).

Null and empty texts have the end id alone. Rows without a doc_id come first; rows of one doc_id are neighbours, in
the order in which they were read. Repeated rows repeat, columns other than doc_id and text are never read, and an
empty table gives no shards. Very long texts are encoded whole and lie in one shard, which they may fill alone.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .bpe import vocabulary
from .common import ensure_checkpoints, spans, table

c = F.col
END, SHARD = 2, 250_000
#: Runs kept between chunks in a worker are of up to so many bytes, and between one and two times so many.
KEPT_BYTES, KEPT_RUNS = 48, 600_000
#: Bytes of text encoded at once.
CHUNK_BYTES = 8_000_000
LETTER, MARK, FEED, CONTROL, SPACE, LEAD, INNER, OTHER = range(8)
#: What a byte of UTF-8 is: an ASCII letter, other visible ASCII, a line feed, other control, a space, the first of a two-byte letter, a later one, any other.
KINDS = np.array([FEED if b == 10 else SPACE if b == 32 else CONTROL if b < 32 or b == 127 else LETTER if chr(b).isalpha() and b < 128 else MARK if b < 128 else INNER if b < 0xC0 else LEAD if 0xC3 <= b <= 0xDF else OTHER for b in range(256)], np.uint8)
#: A pair must occur so often to get a rule; rounds go on while they take away such a share of the symbols.
LEAST_PAIRS, LEAST_GAIN = 8, 0.02
#: Buckets of the hashed counts of pairs, as a power of two.
BUCKET_BITS = 16


def run_starts(data: np.ndarray, starts: np.ndarray, whole: list[bytes]) -> np.ndarray:
    """Where runs start in the UTF-8 bytes of several texts (starts: the texts'), at places where the pattern cuts whatever stands around:

    between an ASCII letter and another ASCII character, between a line feed after visible ASCII and an ASCII letter, and before a space
    between two visible characters. Only ASCII from ! to ~ and two-byte letters from U+00C0 on are taken as visible.
    Nothing is cut within the strings `whole`, the special tokens.
    """
    kind = KINDS[data]
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        before, here = kind[:-1], kind[1:]
        cut[1:] = ((before == LETTER) & (here != LETTER) & (here <= SPACE))
        cut[2:] |= (here[1:] == LETTER) & (before[1:] == FEED) & (kind[:-2] <= MARK)
        at = np.flatnonzero(data[:-1] == 32)
        at = at[at > 1]
        after, last, second = kind[at + 1], kind[at - 1], kind[at - 2]
        seen = (last == LETTER) | (last == MARK) | ((last == INNER) & (second == LEAD))
        cut[at] |= seen & ((after == LETTER) | (after == MARK) | (after == LEAD))
    raw = data.tobytes() if whole else b""
    for token in whole:
        p = raw.find(token)
        while p >= 0:
            cut[p + 1 : p + len(token)] = False
            p = raw.find(token, p + 1)
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Texts to ids by the tokenizers library, each distinct run once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, runs: list[bytes]) -> list[bytes]:
        """The packed ids of distinct runs. Runs that weren't asked for since the kept ones were last renewed are forgotten at the next renewal."""
        out = list(map(self.known.get, runs))
        lost = [i for i, v in enumerate(out) if v is None]
        new = []
        for i in lost:
            if (v := self.older.get(runs[i])) is None:
                new.append(i)
            else:
                out[i] = self.known[runs[i]] = v
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            made = self.tokenizer.encode_batch_fast([runs[i].decode("utf-8", "replace") for i in part], add_special_tokens=False)
            for i, e in zip(part, made, strict=True):
                out[i] = array(self.code, e.ids).tobytes()
                if len(runs[i]) <= KEPT_BYTES:
                    self.known[runs[i]] = out[i]
        if len(self.known) > KEPT_RUNS:
            self.known, self.older = {}, self.known
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids and the end id, as packed unsigned numbers; null counts as empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets - offsets[0]
        starts = run_starts(data, ends[:-1], self.special)
        bounds = np.append(starts, len(data)).astype(np.int64)
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        packed = self._learn(runs.dictionary.to_pylist())
        codes = runs.indices.to_numpy(zero_copy_only=False)
        kind = np.dtype(self.code)
        flat = np.frombuffer(b"".join(packed), kind)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // kind.itemsize
        first = np.cumsum(size) - size
        sizes = size[codes]
        until = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.arange(until[-1]) + np.repeat(first[codes] - until[:-1], sizes)]
        at = until[np.searchsorted(starts, ends)]
        end = array(self.code, [END]).tobytes()
        return [ids[lo:hi].tobytes() + end for lo, hi in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def grammar(ids: np.ndarray, sizes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (rules, symbols, symbols of each document) for documents of `sizes` ids, one after another.

    Each round counts neighbours in hashed buckets, gives one pair of each frequent bucket a rule if it occurs often itself, and
    replaces its places from the left; other pairs of the bucket wait for the next round's hash. Thresholds halve
    from round to round, so the most frequent pairs come first.
    """
    s, top = ids.astype(np.uint32), (1 << 16) if base < 1 << 16 else (1 << 32) - 1
    last = np.zeros(len(s), bool)
    ends = np.cumsum(sizes) - 1
    last[ends[sizes > 0]] = True
    rules: list[np.ndarray] = []
    new, turn, least = base, 0, max(LEAST_PAIRS, len(s) >> 9)
    while len(s) > 1 and new < top:
        h = (s[:-1] * np.uint32(2654435761 + 2 * turn) + s[1:] * np.uint32(2246822519 + 2 * turn)) >> np.uint32(32 - BUCKET_BITS)
        h = h.astype(np.intp)
        at = np.flatnonzero((np.bincount(h, minlength=1 << BUCKET_BITS) >= least)[h])
        at = at[~last[at]]
        h, key = h[at], s[at].astype(np.uint64) << np.uint64(32) | s[at + 1]
        chosen = np.zeros(1 << BUCKET_BITS, np.uint64)
        chosen[h] = key
        own = chosen[h] == key
        at, h = at[own], h[own]
        used = (np.bincount(h, minlength=1 << BUCKET_BITS) >= least)[h]
        at, h = at[used], h[used]
        # Of places that overlap, every second one from the left.
        begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        at, h = at[place % 2 == 0], h[place % 2 == 0]
        left_over = np.bincount(h, minlength=1 << BUCKET_BITS)
        buckets = np.flatnonzero(left_over >= 2)
        if len(buckets) > top - new:
            buckets = np.sort(buckets[np.argsort(-left_over[buckets], kind="stable")][: top - new])
        number = np.zeros(1 << BUCKET_BITS, np.uint32)
        number[buckets] = np.arange(new, new + len(buckets))
        at, h = at[number[h] > 0], h[number[h] > 0]
        rules.append(chosen[buckets])
        new += len(buckets)
        s[at] = number[h]
        last[at] |= last[at + 1]
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        gain = len(at) / len(s)
        s, last = s[stay], last[stay]
        if least == LEAST_PAIRS and gain < LEAST_GAIN:
            break
        least, turn = max(LEAST_PAIRS, least // 8), turn + 1
    keys = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    pairs = np.stack([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
    counts = np.zeros(len(sizes), np.int64)
    counts[sizes > 0] = np.diff(np.flatnonzero(last), prepend=-1)
    return pairs, s, counts


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for; a rule's symbols are older than it."""
    out = [0] * len(rules)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (1 if a < base else out[a - base]) + (1 if b < base else out[b - base])
    return np.array(out, np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: all rules among them are replaced by their two symbols until none is left."""
    s = symbols.astype(np.uint32)
    while len(inner := np.flatnonzero(s >= base)):
        many = np.ones(len(s), np.int64)
        many[inner] = 2
        out = np.repeat(s, many)
        first = (np.cumsum(many) - many)[inner]
        pair = rules[s[inner] - base]
        out[first], out[first + 1] = pair[:, 0], pair[:, 1]
        s = out
    return s


def slice_ids(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a run of symbols; only the symbols that overlap them are expanded."""
    size = np.where(symbols < base, 1, lengths[np.maximum(symbols.astype(np.int64) - base, 0)] if len(lengths) else 1).astype(np.int64)
    until = np.cumsum(size)
    lo, hi = np.searchsorted(until, start, "right"), np.searchsorted(until, stop, "left") + 1
    before = int(until[lo - 1]) if lo else 0
    return expand(symbols[lo:hi], rules, base)[max(start - before, 0) : max(stop - before, 0)]


SHARDS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("first_doc", T.LongType()),
        T.StructField("last_doc", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("base", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("rules", T.BinaryType()),
        T.StructField("lengths", T.BinaryType()),
        T.StructField("symbols", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_symbols", T.BinaryType()),
        T.StructField("doc_tokens", T.BinaryType()),
    ]
)


def to_shard(part: int, shard: int, docs: list, packed: list[bytes], base: int) -> dict:
    """One row of the file format from documents and their packed ids."""
    kind = np.dtype("<u2" if base <= 1 << 16 else "<u4")
    sizes = np.array([len(p) // kind.itemsize for p in packed], np.int64)
    rules, symbols, counts = grammar(np.frombuffer(b"".join(packed), kind), sizes, base)
    width = np.dtype("<u2" if base + len(rules) <= 1 << 16 else "<u4")
    known = [d for d in docs if d is not None]
    return {
        "part": part,
        "shard": shard,
        "first_doc": known[0] if known else None,
        "last_doc": known[-1] if known else None,
        "n_docs": len(docs),
        "n_tokens": int(sizes.sum()),
        "base": base,
        "width": width.itemsize,
        "rules": rules.astype(width).tobytes(),
        "lengths": rule_lengths(rules, base).astype("<u4").tobytes(),
        "symbols": symbols.astype(width).tobytes(),
        "doc_ids": docs,
        "doc_symbols": counts.astype("<u4").tobytes(),
        "doc_tokens": sizes.astype("<u4").tobytes(),
    }


class Shard:
    """A row of the file format, read back."""

    def __init__(self, row: dict):
        kind = f"<u{row['width']}"
        self.base = int(row["base"])
        self.rules = np.frombuffer(row["rules"], kind).reshape(-1, 2).astype(np.uint32)
        self.lengths = np.frombuffer(row["lengths"], "<u4")
        self.symbols = np.frombuffer(row["symbols"], kind)
        self.doc_ids = row["doc_ids"]
        self.tokens = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
        self.until = np.cumsum(np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64))

    def ids(self) -> np.ndarray:
        """The ids of all its documents."""
        return expand(self.symbols, self.rules, self.base)

    def of(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of its k-th document, without expanding others."""
        own = self.symbols[self.until[k - 1] if k else 0 : self.until[k]]
        stop = int(self.tokens[k]) if stop is None else min(stop, int(self.tokens[k]))
        return slice_ids(own, self.rules, self.lengths, self.base, min(max(start, 0), stop), stop)


def doc_bounds(docs: DataFrame, parts: int) -> list[int]:
    """parts - 1 quantiles of doc_id, equal ones where an id is that frequent; read from the ids alone."""
    if parts < 2:
        return []
    found = docs.where(c("doc_id").isNotNull()).agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts).alias("q")).first()["q"]
    return [int(x) for x in found or []]


def encode_sorted(docs: DataFrame, path: str, parts: int) -> DataFrame:
    """part, doc_id, place and ids (packed), each part sorted by doc_id and place, ranges of doc_id in the order of parts.

    Documents of an id that fills several ranges are spread over them in turn.
    """
    bounds = np.array(doc_bounds(docs, parts), np.int64)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("place", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(path)
        for batch in batches:
            ids, place, texts = (batch.column(i) for i in range(3))
            key, turn = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), place.to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
            part = pa.array(np.where(high > low, low + turn % (high - low + 1), low).astype(np.int32))
            for lo, hi in spans(texts, CHUNK_BYTES):
                packed = pa.array(work.encode(texts.slice(lo, hi - lo)), pa.binary())
                yield pa.RecordBatch.from_arrays([part.slice(lo, hi - lo), ids.slice(lo, hi - lo), place.slice(lo, hi - lo), packed], names=schema.names)

    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"), "text")
    return rows.mapInArrow(run, schema).repartitionById(parts, c("part")).sortWithinPartitions("doc_id", "place")


def write_ids(docs: DataFrame, folder: str, path: str, shard: int = SHARD, parts: int | None = None) -> None:
    """Writes the ids of docs (doc_id, text) as a folder of shards. path: a tokenizer's file; parts: ranges of doc_id."""
    spark = docs.sparkSession
    parts, arrow = parts or int(spark.conf.get("spark.sql.shuffle.partitions")), to_arrow_schema(SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = encoder(path).size
        width = 2 if base <= 1 << 16 else 4
        docs, packed, held, n, part = [], [], 0, 0, None
        out = lambda: pa.RecordBatch.from_pylist([to_shard(part, n, docs, packed, base)], schema=arrow)
        for batch in batches:
            for one, doc, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                if docs and (one != part or held + len(ids) // width > shard):
                    yield out()
                    docs, packed, held, n = [], [], 0, n + 1 if one == part else 0
                part = one
                docs.append(doc)
                packed.append(ids)
                held += len(ids) // width
        if docs:
            yield out()

    encode_sorted(docs, path, parts).select("part", "doc_id", "ids").mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(folder)


def read_documents(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of each document, decoded from the files."""
    shards = spark.read.schema(SHARDS).parquet(folder)
    fields = [("part", "int"), ("shard", "int"), ("doc_id", "long"), ("within", "long"), ("n_tokens", "long"), ("ids_crc32", "long"), ("ids", "array<long>")]
    fields = fields if with_ids else fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                ids = shard.ids()
                raw, until = memoryview(ids.astype("<u4").tobytes()), np.cumsum(shard.tokens)
                begins = until - shard.tokens
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), until.tolist(), strict=True)]
                n = len(begins)
                columns = [pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["shard"], np.int32)), pa.array(shard.doc_ids, pa.int64()), pa.array(begins), pa.array(shard.tokens), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, until[-1:]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=[k for k, _ in fields])

    # Totals of ranges, then of shards within their range: no window holds more than the ranges, or one range's shards.
    size = shards.select("part", "shard", "n_tokens")
    order = lambda *by: (Window.partitionBy(*by[:-1]) if by[:-1] else Window.partitionBy()).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = size.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(order("part")), F.lit(0)).alias("before_part"))
    before = size.select("part", "shard", F.coalesce(F.sum("n_tokens").over(order("part", "shard")), F.lit(0)).alias("before_shard")).join(parts, "part")
    read = shards.select(*(k for k in shards.columns if k not in ("first_doc", "last_doc", "n_docs", "n_tokens"))).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in fields))
    placed = read.join(before, ["part", "shard"])
    return placed.select("doc_id", (c("before_part") + c("before_shard") + c("within")).alias("start"), *(k for k, _ in fields[4:]))


def read_range(spark: SparkSession, folder: str, doc_id: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """doc_id and ids start to stop of each document of that doc_id: other shards are skipped by their bounds, and only the symbols that overlap are expanded."""
    found = spark.read.schema(SHARDS).parquet(folder).where((c("first_doc") <= doc_id) & (c("last_doc") >= doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                for k, doc in enumerate(shard.doc_ids):
                    if doc == doc_id:
                        yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([shard.of(k, start, stop).tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return found.mapInArrow(run, "doc_id long, ids array<long>")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    ensure_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents, writes the files in the shared folder and reads them back."""
    folder = new_folder(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return read_documents(spark, folder, with_ids=False)


QUERIES = {"op13_token_ids": op13_token_ids}
ORACLES: dict[str, str] = {}
