"""Conversation prefix trie: conversations are rebuilt and merged within their family, then families' nodes globally.

A family is the conversations of one base id (conv_id less its remainder by FAMILY). Turns are digested first, so
texts are never shuffled; turns and the base conversation's first turns are cogrouped by base id, and a
family is read as a stream, sorted by conversation and turn. Each conversation's prefixes are chained digests; the family's
small trie combines equal ones, and only its nodes are shuffled to be merged (family_nodes, merge_nodes).

What a node sums over its subtree follows from its members, without walking the trie. Of the prefixes of a
conversation, those from some depth on have it as their smallest member (first_own); each node belongs so to one conversation. For a
node of depth d, the sum of n_convs times bytes is that of its members' bytes from depth d on, the sum of bytes that of
its members' own nodes from depth d on, and childless nodes are counted by the conversations that own them.
Families send these shares, combined again, and one grouped sum makes the trie whole.

Prefixes count as equal if their SHA-256 digests do. Turns of equal number are ordered by the digest of role and text, rows without a
conv_id belong to no conversation, other columns are never read, and an empty table gives no nodes. A conversation of
any length is read as a stream, in memory that is bounded by TRIE_NODES: a family with more nodes sends
some of them in several parts. The conv_ids of a node's ends are joined in chunks where they are sorted, and the
chunks are hashed in order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ensure_checkpoints, table

c = F.col
FAMILY, HEADS = 5, 9
#: Nodes of a family's trie that are held at once, and rows of a batch that is sent.
TRIE_NODES, BATCH = 100_000, 20_000
#: Characters of joined conv_ids in a chunk.
CHUNK = 1_000_000
ROOT = hashlib.sha256(b"").digest()
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def digested(turns: DataFrame) -> DataFrame:
    """base, conv_id, turn, digest of (role, text) and n_bytes of the text."""
    role, text = (F.coalesce(c(k).cast("string"), F.lit("")) for k in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    conv = c("conv_id").cast("long")
    return turns.where(conv.isNotNull()).select((conv - conv % FAMILY).alias("base"), conv.alias("conv_id"), c("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def cogrouped(turns: DataFrame) -> DataFrame:
    """All turns of a family together, the base conversation's first, each conversation's in order.

    The base conversation's turns are the head of each of its family, so its rows come first (-1) and again as its own (0).
    """
    rows = digested(turns)
    # Only the first turns of a base conversation are heads; there are at most HEADS - 1 of them.
    heads = rows.where("conv_id = base").withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(c("turn").asc_nulls_first(), "digest"))).where(c("at") < HEADS).drop("at")
    both = rows.withColumn("side", F.lit(1)).unionByName(heads.withColumn("side", F.lit(0)))
    return both.repartition("base").sortWithinPartitions("base", "side", "conv_id", c("turn").asc_nulls_first(), "digest").select("base", "side", "conv_id", "digest", "n_bytes")


def head_of(conv: int) -> int:
    """How many of the base conversation's turns stand before a conversation's own."""
    return zlib.crc32(str(conv).encode()) % HEADS


PATHS = T.StructType(
    [
        T.StructField("base", T.LongType()),
        T.StructField("conv_id", T.LongType()),
        T.StructField("depth", T.LongType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("parent", T.BinaryType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("so_far", T.LongType()),
        T.StructField("last", T.BooleanType()),
    ]
)


def rebuilt_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The prefixes (as PATHS) of rebuilt conversations, from rows as cogrouped gives them; a row for each depth, the root's first.

    so_far: bytes of the texts up to that depth; last: whether the conversation ends there.
    """
    base = conv = None
    heads: list[tuple] = []
    held = skip = None

    def step(before: tuple, digest: bytes, n: int) -> tuple:
        return (before[0], before[1], before[2] + 1, hashlib.sha256(before[3] + digest).digest(), before[3], n, before[6] + n)

    for b, side, one, digest, n in rows:
        if b != base:
            if held:
                yield (*held, True)
            base, conv, heads, held = b, None, [], None
        if side == 0:
            heads.append((digest, n))
            continue
        if one != conv:
            if held:
                yield (*held, True)
            conv, skip = one, head_of(one)
            held = (base, conv, 0, ROOT, None, 0, 0)
            for d, m in heads[:skip]:
                yield (*held, False)
                held = step(held, d, m)
        if skip:
            skip -= 1
            continue
        yield (*held, False)
        held = step(held, digest, n)
    if held:
        yield (*held, True)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def rebuilt(turns: DataFrame) -> DataFrame:
    """base, conv_id, depth, node (digest of the prefix), parent, n_bytes, so_far, last: each prefix of each rebuilt conversation."""
    arrow = to_arrow_schema(PATHS)
    return cogrouped(turns).mapInArrow(lambda batches: _batches(rebuilt_rows(_rows(batches)), arrow), PATHS)


def _by_family(rows: Iterator[tuple], key: int, combine) -> Iterator[tuple]:
    """Combines rows (base first) that agree in column `key` within a family; rows of a family are neighbours."""
    base, trie = None, {}
    for row in rows:
        if row[0] != base or len(trie) >= TRIE_NODES:
            yield from trie.values()
            base, trie = row[0], {}
        old = trie.get(row[key])
        trie[row[key]] = combine(old, row)
    yield from trie.values()


def family_nodes(paths: DataFrame) -> DataFrame:
    """The nodes of each family's trie: node, parent, depth, n_bytes, n_convs, conv_id (smallest member). paths: as rebuilt gives them, not shuffled since."""
    schema = T.StructType([*(T.StructField(k, T.BinaryType()) for k in ("node", "parent")), *(T.StructField(k, T.LongType()) for k in ("depth", "n_bytes", "n_convs", "conv_id"))])
    arrow = to_arrow_schema(schema)

    def add(old, row):
        _, conv, depth, node, parent, n = row
        return (node, parent, depth, n, 1, conv) if old is None else (*old[:4], old[4] + 1, min(old[5], conv))

    def run(batches):
        return _batches(_by_family(_rows(batches), 3, add), arrow)

    return paths.select("base", "conv_id", "depth", "node", "parent", "n_bytes").mapInArrow(run, schema)


def merge_nodes(families: DataFrame) -> DataFrame:
    """The global trie's nodes from families' nodes; the root's parent is null."""
    return families.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("n_bytes").alias("n_bytes"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))


def shares(rows: Iterator[tuple]) -> Iterator[tuple]:
    """base, node, saved and leaves for each prefix, from rows (base, conv_id, first_own, owns_leaf, depth, node, n_bytes, so_far).

    A conversation's row of first_own and owns_leaf comes first if it owns a node, then its prefixes from the deepest to the root.
    """
    conv = first = leaf = total = before_own = None
    for base, one, first_own, owns_leaf, depth, node, n, so_far in rows:
        if one != conv:
            conv, first, leaf, total = one, None, False, None
        if depth is None:
            first, leaf = first_own, owns_leaf
            continue
        if total is None:
            total = before_own = so_far
        before = so_far - n
        if first is not None and depth >= first:
            before_own = before
        yield base, node, before_own - before, int(leaf)


def family_shares(paths: DataFrame, own: DataFrame) -> DataFrame:
    """node, saved_tokens and n_leaves: what each family adds to its nodes' subtree sums.

    own: conv_id, first_own and owns_leaf. Both are dealt by base id, so no node's members meet in a task.
    """
    owners = own.select((c("conv_id") - c("conv_id") % FAMILY).alias("base"), "conv_id", "first_own", "owns_leaf")
    both = paths.select("base", "conv_id", "depth", "node", "n_bytes", "so_far").unionByName(owners, allowMissingColumns=True)
    dealt = both.repartition("base").sortWithinPartitions("base", "conv_id", c("depth").desc_nulls_first()).select("base", "conv_id", "first_own", "owns_leaf", "depth", "node", "n_bytes", "so_far")
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("saved", T.LongType()), T.StructField("leaves", T.LongType())])
    arrow = to_arrow_schema(schema)

    def add(old, row):
        return row[1:] if old is None else (old[0], old[1] + row[2], old[2] + row[3])

    combined = dealt.mapInArrow(lambda batches: _batches(_by_family(shares(_rows(batches)), 1, add), arrow), schema)
    return combined.groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))


def hashed_ends(paths: DataFrame) -> DataFrame:
    """node and ends_sha256: the digest of the sorted conv_ids that end there, comma-joined.

    Sorted by node and id over all partitions, a frequent node's ids lie in several of them, which join them in
    chunks; one task hashes a node's few chunks in order.
    """
    ends = paths.where("last").select("node", "conv_id")
    parts = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("first", T.LongType()), T.StructField("ids", T.StringType())])
    whole = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("ends_sha256", T.StringType())])
    arrow, final = to_arrow_schema(parts), to_arrow_schema(whole)

    def chunked(rows):
        node, ids, size = None, [], 0
        for one, conv in rows:
            if one != node or size > CHUNK:
                if ids:
                    yield node, int(ids[0]), ",".join(ids)
                node, ids, size = one, [], 0
            ids.append(str(conv))
            size += len(ids[-1])
        if ids:
            yield node, int(ids[0]), ",".join(ids)

    def digests(rows):
        node, state = None, None
        for one, ids in rows:
            if one != node:
                if state:
                    yield node, state.hexdigest()
                node, state = one, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if state:
            yield node, state.hexdigest()

    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(lambda b: _batches(chunked(_rows(b)), arrow), parts)
    return chunks.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(lambda b: _batches(digests(_rows(b)), final), whole)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, from turns (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Prefixes and merged nodes are checkpointed, as several steps read them.
    """
    ensure_checkpoints(turns.sparkSession)
    paths = rebuilt(turns).checkpoint()
    nodes = merge_nodes(family_nodes(paths)).checkpoint()
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).select(c("parent").alias("node"), "n_children")
    counted = nodes.join(children, "node", "left").na.fill(0, ["n_children"])
    own = counted.groupBy("conv_id").agg(F.min("depth").alias("first_own"), F.bool_or(c("n_children") == 0).alias("owns_leaf"))
    # A node below another of the same smallest member has it as its parent's too; only the first such node looks its parent up.
    first = nodes.join(own.select("conv_id", "first_own"), "conv_id").where("depth = first_own and parent is not null").select("node", "parent")
    above = first.join(nodes.select(c("node").alias("parent"), c("conv_id").alias("above")), "parent").select("node", "above")
    summed = counted.join(family_shares(paths, own), "node").join(hashed_ends(paths), "node", "left").join(above, "node", "left")
    return summed.select(
        "conv_id",
        "depth",
        F.when(c("parent").isNotNull(), F.coalesce("above", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


# crc32 byte by byte, prefixes as concatenated digests, and every node summed over the chains of smallest members below it.
_SQL = f"""
WITH RECURSIVE bits(b, k, v) AS (
    SELECT b, 0, b::BIGINT FROM range(256) t(b)
    UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
crc(conv_id, i, v) AS (
    SELECT DISTINCT conv_id, 0, 4294967295::BIGINT FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT conv_id, i + 1, xor(v >> 8, t.x) FROM crc JOIN (SELECT b, v AS x FROM bits WHERE k = 8) t ON t.b = xor(v, ascii(substring(conv_id::VARCHAR, i + 1, 1))::BIGINT) & 255 WHERE i < length(conv_id::VARCHAR)),
head AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, xor(v, 4294967295::BIGINT) % {HEADS} AS h FROM crc WHERE i = length(conv_id::VARCHAR)),
turns AS (SELECT conv_id, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, octet_length(encode(coalesce(text, ''))) AS n, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, d, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS i FROM turns),
whole AS (
    SELECT h.conv_id, 0 AS side, o.i, o.d, o.n FROM head h JOIN own o ON o.conv_id = h.base AND o.i <= h.h
    UNION ALL SELECT h.conv_id, 1, o.i, o.d, o.n FROM head h JOIN own o ON o.conv_id = h.conv_id AND o.i > h.h),
paths AS (
    SELECT conv_id, row_number() OVER w AS depth, string_agg(d, '') OVER w AS node, n FROM whole WINDOW w AS (PARTITION BY conv_id ORDER BY side, i)
    UNION ALL SELECT conv_id, 0, '', 0 FROM head),
nodes AS (SELECT node, depth, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs FROM paths GROUP BY node, depth),
parents AS (SELECT *, CASE WHEN depth > 0 THEN left(node, length(node) - 64) END AS parent FROM nodes),
children AS (SELECT parent, count(*) AS n_children FROM parents WHERE parent IS NOT NULL GROUP BY parent),
whole_nodes AS (SELECT p.*, coalesce(k.n_children, 0) AS n_children FROM parents p LEFT JOIN children k ON k.parent = p.node),
below AS (
    SELECT a.node, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.n) AS saved_tokens
    FROM whole_nodes u JOIN paths a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.node),
ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, arg_max(node, depth) AS node FROM paths GROUP BY conv_id) t GROUP BY node)
SELECT v.conv_id, v.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, coalesce(e.sha, '{EMPTY_SHA}') AS ends_sha256
FROM whole_nodes v JOIN below b ON b.node = v.node LEFT JOIN ends e ON e.node = v.node LEFT JOIN nodes up ON up.node = v.parent
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": _SQL}
