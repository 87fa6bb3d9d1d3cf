"""Near-duplicate groups by an LSH forest over MinHash signatures, with exact confirmation.

Words are runs without ASCII white space, A-Z in lower case; a document's set are its distinct
shingles of `width` words, or the whole sequence if it has fewer. Documents with equal sets are one
node. Each node has a signature of HASHES minima, and each of TREES trees sorts all nodes by the
signature's values in an order of its own. Nodes are candidates if they share a prefix of at least
four values in some order (a region):

1. In the first FIRST trees, each node and its neighbours in the sorted order, those with the
   longest common prefix, and each node and the centre of its run of the region, the node nearest to
   the majority of the run's sketches. Confirmed links already join most groups, however large they are,
   and there are a few candidates for each node.
2. In all trees, all pairs that aren't joined yet of regions of up to CROWD nodes.
3. The nodes of larger regions that aren't one group yet are joined by the rare shingles of their full
   sets (prefix, length and positional filters), all with all. That misses no link between
   them, whatever region they met in, and needs no cut of a region.

A pair of 1 and 2 goes on if the lengths allow the similarity and a sketch of two bits for each hash
doesn't rule it out (at SPREAD standard deviations). All pairs are then confirmed on the full sets: a
link if 100 * intersection >= percent * union. Components of the links are the groups.

Null and empty texts have the empty set and link with nothing. Rows without a doc_id link with
nothing either, and their component_id is null. Rows that repeat a doc_id and its text are one
document and share all values; rows of one doc_id with different texts are different documents, each
with its own text's group. With no rows there are none. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_checkpoints, map_texts, table
from .components import components

HASHES, TREES, FIRST = 128, 24, 6
#: Nodes of a region compared in pairs; nodes that share a centre (a longer region has several, which meet).
CROWD, RUN = 32, 2048
#: Buckets in which the frequencies of crowds' shingles are kept; they only order the shingles.
BUCKETS = 1 << 20
#: How unlike two sketches may be, in standard deviations from the mean at the similarity asked for.
SPREAD = 4.0
#: Rows of sorted regions read at once in a worker, and words whose hashes it keeps.
ROWS_AT_ONCE, CACHE_ENTRIES = 50_000, 100_000
#: Sets kept while a task confirms pairs.
HELD_SETS = 256
_RNG = np.random.default_rng(20240229)
MULTIPLY = _RNG.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
ADD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
ORDERS = np.stack([_RNG.permutation(HASHES)[:8] for _ in range(TREES)])
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORDS: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * P2
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes, both know ASCII only
    known = _WORDS
    if len(known) > CACHE_ENTRIES:
        known.clear()
    found = list(map(known.get, words))
    if None in found:
        digest = xxhash.xxh3_64_intdigest
        for i, h in enumerate(found):
            if h is None:
                w = words[i]
                found[i] = known[w] = digest(w)
    return np.array(found, np.uint64)


def shingles(text: str, width: int) -> np.ndarray:
    """The set as sorted 64-bit hashes."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    size = min(n, width)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = _mix(out * P1 + h[i : n - size + 1 + i] + np.uint64(i + 1))
    return np.unique(out)


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def signature(s: np.ndarray) -> bytes:
    """16 mixed bits of the smallest value under each of the HASHES permutations."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[at : at + 1024, None] * MULTIPLY + ADD).min(axis=0), out=low)
    return ((low * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16).tobytes()


def described(docs: DataFrame, width: int, text: str, keep: list[str]) -> DataFrame:
    """keep, n_shingles, node and sig; node and sig are null for empty sets."""

    def make():
        def work(texts):
            sizes, nodes, sigs = [], [], []
            for t in texts:
                s = shingles(t, width)
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            return sizes, nodes, sigs

        return work

    return map_texts(docs, text, T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("sig", T.BinaryType())]), make, keep)


ROW = "tree int, hi long, lo long, node long, size int, root long, s0 long, s1 long, t0 long, t1 long"
SKETCH = ("s0", "s1", "t0", "t1")


def tree_rows(nodes: DataFrame, trees: range) -> DataFrame:
    """nodes: node, size, root, sig. A row for each node and tree: the order's first eight values and the sketch."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sig = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint16).reshape(-1, HASHES)
                n = len(sig)
                sketch = [np.packbits(((sig >> b) & 1).astype(np.uint8), axis=1).view(np.int64) for b in (0, 1)]
                for tree in trees:
                    key = np.ascontiguousarray(sig[:, ORDERS[tree]].astype(">u2")).view(">i8").astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, tree, np.int32)), pa.array(key[:, 0]), pa.array(key[:, 1]), part.column(0), part.column(1).cast(pa.int32()), part.column(2), *(pa.array(s[:, i]) for s in sketch for i in (0, 1))],
                        names=["tree", "hi", "lo", "node", "size", "root", *SKETCH],
                    )

    return nodes.select("node", "size", "root", "sig").mapInArrow(run, ROW)


def most_unlike(percent: int, spread: float) -> int:
    """Hashes whose two sketch bits differ at most, for sets of that similarity."""
    p = (1 - percent / 100) * 0.75
    return int(np.ceil(HASHES * p + spread * np.sqrt(HASHES * p * (1 - p))))


def differing(cols: dict[str, np.ndarray], i, k) -> np.ndarray:
    """In how many hashes the sketches of rows i and k differ."""
    # Of signed values bitwise_count would count the absolute value's bits.
    first, second = (np.bitwise_count(((cols[s][i] ^ cols[s][k]) | (cols[t][i] ^ cols[t][k])).view(np.uint64)) for s, t in (("s0", "t0"), ("s1", "t1")))
    return first + second


def _alike(cols: dict[str, np.ndarray], i, k, percent: int, unlike: int) -> np.ndarray:
    """Whether rows i and k have different roots and may be similar."""
    size, root = cols["size"], cols["root"]
    small, large = np.minimum(size[i], size[k]), np.maximum(size[i], size[k])
    return (root[i] != root[k]) & (small * 100 >= large * percent) & (differing(cols, i, k) <= unlike)


def _regions(cols: dict[str, np.ndarray]) -> np.ndarray:
    """Where regions begin, and the number of rows."""
    new = np.ones(len(cols["node"]), bool)
    new[1:] = (cols["tree"][1:] != cols["tree"][:-1]) | (cols["hi"][1:] != cols["hi"][:-1])
    return np.append(np.flatnonzero(new), len(new))


def _pairs(cols: dict[str, np.ndarray], edges: np.ndarray, reach: int, percent: int, unlike: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows up to `reach` places apart in one region that may be similar and have different roots."""
    node, n = cols["node"], int(edges[-1])
    end, at = np.repeat(edges[1:], np.diff(edges)), np.arange(n)
    for d in range(1, reach + 1):
        at = at[at + d < end[at]]
        if not len(at):
            return
        fits = at[_alike(cols, at, at + d, percent, unlike)]
        yield node[fits], node[fits + d]


def _centre(cols: dict[str, np.ndarray], lo: int, hi: int) -> int:
    bits = np.unpackbits(np.ascontiguousarray(np.stack([cols[c][lo:hi] for c in SKETCH], axis=1)).view(np.uint8), axis=1)
    return lo + int((bits != (bits.mean(axis=0) >= 0.5)).sum(axis=1).argmin())


def _to_centres(cols: dict[str, np.ndarray], edges: np.ndarray, percent: int, unlike: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each node of a region of four and more with the centre of its run, and each run's centre with the one before."""
    node = cols["node"]
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo < 4:
            continue
        last = None
        for at in range(lo, hi, RUN):
            to = min(at + RUN, hi)
            centre = _centre(cols, at, to)
            ok = at + np.flatnonzero(_alike(cols, np.arange(at, to), np.full(to - at, centre), percent, unlike))
            yield node[ok], np.full(len(ok), node[centre])
            if last is not None:
                yield node[[last]], node[[centre]]
            last = centre


def _sorted_rows(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return rows.repartition("tree", "hi").sortWithinPartitions("tree", "hi", "lo", "root", "node").mapInArrow(run, schema)


def _read(batches) -> Iterator[dict[str, np.ndarray]]:
    names = [f.split()[0] for f in ROW.split(", ")]
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(lo, ROWS_AT_ONCE)
            yield {c: part.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}


def _and(held: dict[str, np.ndarray] | None, new: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}


def _of(cols: dict[str, np.ndarray], which) -> dict[str, np.ndarray]:
    return {c: v[which] for c, v in cols.items()}


def _both(pairs) -> Iterator[pa.RecordBatch]:
    for a, b in pairs:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def neighbours_run(percent: int) -> Callable:
    """Pairs of nodes (a < b) of sorted rows: next to each other, or a node and its run's centre.

    A region is read as a stream; of a part that fills ROWS_AT_ONCE the last row and a centre go on to the next part.
    """
    unlike = most_unlike(percent, SPREAD)

    def found(cols):
        edges = _regions(cols)
        yield from _both(_pairs(cols, edges, 1, percent, unlike))
        yield from _both(_to_centres(cols, edges, percent, unlike))

    def run(batches):
        held = None
        for new in _read(batches):
            held = _and(held, new)
            if len(held["node"]) < ROWS_AT_ONCE:
                continue
            edges = _regions(held)
            if len(edges) > 2:
                yield from found(_of(held, slice(None, edges[-2])))
                held = _of(held, slice(edges[-2], None))
            else:
                yield from found(held)
                held = _of(held, [_centre(held, max(0, edges[-1] - RUN), edges[-1]), edges[-1] - 1])
        if held is not None:
            yield from found(held)

    return run


def neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of nodes (a < b) that are neighbours in a tree's order or a node and a centre."""
    return _sorted_rows(rows, neighbours_run(percent), "a long, b long").distinct()


def region_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """What the regions hold: pairs of nodes (a, b) from regions of up to CROWD nodes, with a null region, and of larger ones each node, as a, and its root, as b.

    A large region is read as a stream; at most CROWD rows wait for the next part.
    """
    unlike = most_unlike(percent, SPREAD)

    def members(cols):
        yield pa.RecordBatch.from_arrays([pa.array(cols[c]) for c in ("node", "root", "hi")] + [pa.array(cols["tree"], pa.int32())], names=["a", "b", "hi", "tree"])

    def whole(cols):
        """Of regions that end here."""
        edges = _regions(cols)
        size, mixed = np.diff(edges), np.maximum.reduceat(cols["root"], edges[:-1]) != np.minimum.reduceat(cols["root"], edges[:-1])
        small, large = np.repeat(mixed & (size <= CROWD), size), np.repeat(mixed & (size > CROWD), size)
        if small.any():
            part = _of(cols, small)
            for a, b in _pairs(part, _regions(part), CROWD - 1, percent, unlike):
                if len(a):
                    n = len(a)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=["a", "b", "hi", "tree"])
        if large.any():
            yield from members(_of(cols, large))

    def run(batches):
        held, open_region = None, None  # open_region: its rows go out as they come
        for new in _read(batches):
            held = _and(held, new)
            if open_region is not None:
                more = int(((held["tree"] == open_region[0]) & (held["hi"] == open_region[1])).sum())
                if more:
                    yield from members(_of(held, slice(None, more)))
                    held = _of(held, slice(more, None))
                if not len(held["node"]):
                    held = None
                    continue
                open_region = None
            edges = _regions(held)
            if edges[-2]:
                yield from whole(_of(held, slice(None, edges[-2])))
                held = _of(held, slice(edges[-2], None))
            if len(held["node"]) > CROWD:
                open_region = held["tree"][0], held["hi"][0]
                yield from members(held)
                held = None
        if held is not None:
            yield from whole(held)

    return _sorted_rows(rows, run, "a long, b long, hi long, tree int")


def crowded(found: DataFrame) -> DataFrame:
    """The nodes of large regions that have several roots."""
    members = found.where("tree IS NOT NULL")
    mixed = members.groupBy("tree", "hi").agg(F.min("b").alias("low"), F.max("b").alias("top")).where("low != top").select("tree", "hi").checkpoint()
    return members.join(mixed, ["tree", "hi"]).select(F.col("a").alias("node")).distinct()


def frequencies(tokens: DataFrame) -> np.ndarray:
    """For each bucket of shingles the count of its most frequent one that several roots hold, 0 where there is none. tokens: token, root.

    At most BUCKETS rows reach the driver.
    """
    shared = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("top")).where("low != top")
    made = shared.groupBy(F.col("token").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[made.column("bucket").to_numpy()] = made.column("n").to_numpy()
    return out


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """token, node, root, size, rest and first: the shingles of each set among which similar sets of other roots share one.

    The order is that of the buckets' counts, then of the hashes. Shingles of a bucket that counts 0 are
    only held by one root. rest: the set's other shingles from this one on, which bounds what a pair that first
    meets here can share. first: it is early enough for the smaller set of a pair, else only for the larger one.
    """
    sent = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        counts = sent.value
        for batch in batches:
            out = []
            for node, root, s in zip(*(batch.column(i).to_pylist() for i in (0, 1)), (np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()), strict=True):
                n = counts[s & (BUCKETS - 1)]
                known = n > 0
                t, n = s[known], n[known]
                rest = len(t) - np.arange(len(t))
                keep = int((rest * 100 >= len(s) * percent).sum())
                if keep:
                    order = np.lexsort((t, n))[:keep]
                    out.append((t[order], node, root, len(s), rest[:keep]))
            if out:
                k = [len(x[0]) for x in out]
                size, rest = np.repeat([x[3] for x in out], k).astype(np.int32), np.concatenate([x[4] for x in out]).astype(np.int32)
                first = rest.astype(np.int64) * (100 + percent) >= size.astype(np.int64) * (2 * percent)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array(np.repeat(np.array([x[1] for x in out], np.int64), k)), pa.array(np.repeat(np.array([x[2] for x in out], np.int64), k)), pa.array(size), pa.array(rest), pa.array(first)], names=["token", "node", "root", "size", "rest", "first"])

    return sets.select("node", "root", "tokens").mapInArrow(run, "token long, node long, root long, size int, rest int, first boolean")


def crowd_pairs(nodes: DataFrame, docs: DataFrame, width: int, percent: int, text: str, key: str) -> DataFrame:
    """Distinct pairs of nodes (a < b) with different roots, among them all that are similar enough. nodes: node, rep, root.

    A set x is as large as y or smaller. Of a pair, first y is held against what the sets x of another root with
    the same shingle can reach together, so that the members of one group are never paired with each other,
    and only where that suffices against each of them.
    """

    def make():
        def work(texts):
            sets = [shingles(t, width) for t in texts]
            return [s.tobytes() for s in sets], [node_of(s) if len(s) else None for s in sets]

        return work

    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("__t")).join(nodes.select("node", "rep", "root"), "rep")
    sets = map_texts(texts, "__t", T.StructType([T.StructField("tokens", T.BinaryType()), T.StructField("named", T.LongType())]), make, ["node", "root"]).where("named = node").select("node", "root", "tokens").checkpoint()

    def apart(batches):
        for batch in batches:
            parts = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in parts]))], names=["token", "root"])

    counts = frequencies(sets.select("root", "tokens").mapInArrow(apart, "token long, root long"))
    kept = prefixes(sets, counts, percent).checkpoint()
    p, q = percent, 100 + percent
    x = kept.where("first").select("token", F.col("root").alias("xroot"), F.col("node").alias("xnode"), F.col("size").alias("xsize"), F.col("rest").alias("xrest"))
    reach = x.groupBy("token", "xroot").agg(F.min("xsize").alias("least"), F.max("xsize").alias("most"), F.max(F.col("xrest") * q - F.col("xsize") * p).alias("spare")).checkpoint()
    able = (F.col("root") != F.col("xroot")) & (F.col("least") <= F.col("size")) & (F.col("most") * 100 >= F.col("size") * p) & (F.col("spare") >= F.col("size") * p) & (F.col("rest") * q - F.col("size") * p >= F.col("least") * p)
    y = kept.join(reach, "token").where(able).select("token", "xroot", "node", "size", "rest").checkpoint()
    fits = (F.col("xsize") <= F.col("size")) & (F.col("xsize") * 100 >= F.col("size") * p) & (F.least("xrest", "rest") * q >= (F.col("xsize") + F.col("size")) * p)
    return y.join(x, ["token", "xroot"]).where(fits).select(F.least("node", "xnode").alias("a"), F.greatest("node", "xnode").alias("b")).distinct()


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int, text: str, key: str) -> DataFrame:
    """The pairs whose full sets are similar enough. nodes: node, rep (a document's key); docs: key, text."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "rep"), "node")
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("__t")).join(wanted, "rep")

    def make():
        press = zstandard.ZstdCompressor(level=1).compress
        return lambda ts: [[press(t.encode("utf-8", "surrogatepass")) for t in ts]]

    packed = map_texts(texts, "__t", T.StructType([T.StructField("packed", T.BinaryType())]), make, ["node"])

    def check(batches):
        unpack, held = zstandard.ZstdDecompressor().decompress, {}

        def set_of(node, data):
            if node not in held:
                if len(held) >= HELD_SETS:
                    held.clear()
                held[node] = shingles(unpack(data.as_py()).decode("utf-8", "surrogatepass"), width)
            return held[node]

        for batch in batches:
            a, b, x, y = batch.columns
            ok = []
            for i, (m, n) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                s, t = set_of(m, x[i]), set_of(n, y[i])
                if node_of(s) != m or node_of(t) != n:
                    held.clear()
                    continue  # another text under the same key
                both = np.concatenate([s, t])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    ok.append(i)
            if ok:
                yield pa.RecordBatch.from_arrays([a.take(ok), b.take(ok)], names=["a", "b"])

    first = pairs.join(packed.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a")
    both = first.join(packed.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def grouped(docs: DataFrame, width: int, percent: int, text: str, key: str, keep: list[str]) -> DataFrame:
    """keep, n_shingles, node, component (the smallest key reachable) and keeper (the node that stays); the last three are null where the set is empty, the last two also without a key."""
    ensure_checkpoints(docs.sparkSession)
    rows = described(docs, width, text, list(dict.fromkeys([key, *keep]))).checkpoint()
    of = rows.where(F.col("node").isNotNull() & F.col(key).isNotNull())
    nodes = of.groupBy("node").agg(F.min(key).alias("rep"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig")).checkpoint()
    texts = docs.select(key, text)
    if not of.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        texts = texts.distinct()  # repeated rows would repeat in every join
    found = confirm(neighbours(tree_rows(nodes.withColumn("root", F.col("node")), range(FIRST)), percent).checkpoint(), nodes, texts, width, percent, text, key).checkpoint()
    roots = components(found).checkpoint()
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = region_pairs(tree_rows(joined, range(TREES)), percent).checkpoint()
    pairs, crowds = met.where("tree IS NULL").select("a", "b"), crowded(met).checkpoint()
    if not crowds.isEmpty():
        pairs = pairs.union(crowd_pairs(joined.join(crowds, "node"), texts, width, percent, text, key))
    more = confirm(pairs.distinct().checkpoint(), nodes, texts, width, percent, text, key)
    named = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    over = components(named.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    final = joined.select("node", "rep", "root").join(over.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", "rep", F.coalesce("top", "root").alias("top")).checkpoint()
    least = final.groupBy("top").agg(F.min(F.struct("rep", "node")).alias("least")).checkpoint()
    labels = final.join(least, "top").select("node", F.col("least.rep").alias("component"), F.col("least.node").alias("keeper"))
    known = rows.where(F.col("node").isNotNull() & F.col(key).isNotNull()).join(labels, "node").select(*keep, "n_shingles", "node", "component", "keeper")
    rest = rows.where(F.col("node").isNull() | F.col(key).isNull())
    return known.unionByName(rest.select(*keep, "n_shingles", "node", F.col(key).alias("component"), F.lit(None).cast("long").alias("keeper")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable) and kept (key = component_id), a row for each row of docs."""
    out = grouped(docs, width, percent, text, key, [key])
    return out.select(key, "n_shingles", F.col("component").alias("component_id"), F.col(key).eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without all but one document of each group: the text of the smallest key stays, of several texts under that key one."""
    named = docs.withColumns({"__hash": F.xxhash64(text), "__size": F.length(text)})
    mine = ["__key", "__hash", "__size"]
    sets = grouped(named.select(F.col(key).alias("__key"), F.col(text).alias("__text"), "__hash", "__size"), width, percent, "__text", "__key", mine)
    gone = sets.where(F.col("keeper").isNotNull() & ((F.col("__key") != F.col("component")) | (F.col("node") != F.col("keeper")))).select(*mine).distinct()
    return named.withColumn("__key", F.col(key)).join(gone, mine, "left_anti").select(*docs.columns)


def op8_neardup(spark, sf_dir: str) -> DataFrame:
    """Groups of documents that share 80 of 100 distinct shingles of two words."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2, percent=80)


QUERIES = {"op8_neardup": op8_neardup}
ORACLES: dict[str, str] = {}
