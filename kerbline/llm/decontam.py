"""Benchmark decontamination: MinHash containment search for short items in long documents.

Native: DataFrame functions only. Words are runs of ASCII letters and digits and all
other characters beyond ASCII, in lower case, and a text's set are its distinct shingles of WIDTH words, or the whole sequence if it has
fewer. An item with n shingles is contained in a document if at least need = ceil(n * percent / 100)
of them are among the document's.

Plain MinHash fails here: a document hundreds of times as long hides an item's minima. So items
are partitioned by size, and every shingle has one hash. An item's signature is its n - need + 1
smallest hashes (bottom-k MinHash with k set by the partition); a document that contains the
item lacks at most n - need of its shingles, so it has one of the signature's. That finds every
containment, however long the document. A document's hash is looked up in those partitions whose
largest signature value it doesn't pass: the larger the items of a partition, the fewer of a document's hashes
reach it, and most never leave the scan. Candidates are then verified on the exact shingles, as strings.

An item of fewer than WIDTH words is one shingle of its own width, and only a document that equals it
holds that. Null and empty texts and items have no set and match nothing; repeated rows of an item
count once per item_id, repeated documents repeat; rows without a doc_id are searched by the
decontaminating stage too, as it works by text. Ties don't arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoints, table

WIDTH, PERCENT = 5, 80
#: Largest table that is broadcast, in signature values, shingles or candidates; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Item sizes from which the next partition begins, in shingles.
PARTITIONS = (1, 2, 6, 16, 46, 136, 406, 1216)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null for null."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def starts(w: Column, width: int) -> Column:
    """The places where a shingle starts, from 1; none without words."""
    return F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))


def shingle_texts(w: Column, width: int) -> Column:
    """The distinct shingles as strings."""
    return F.array_distinct(F.transform(starts(w, width), lambda i: F.array_join(F.slice(w, i, F.lit(width)), " ")))


def shingle_hashes(w: Column, width: int) -> Column:
    """A 64-bit hash for each shingle, in text order. A missing word hashes as null, so sizes never mix."""
    return F.transform(starts(w, width), lambda i: F.xxhash64(*(F.get(w, i + (k - 1)) for k in range(width))))


def partition_of(n: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(PARTITIONS):
        out = F.when(n >= least, k).otherwise(out)
    return out


def item_index(items: DataFrame, width: int = WIDTH, percent: int = PERCENT, key: str = "item_id", text: str = "text") -> DataFrame:
    """A row for each item text: key, shingles (strings), n, need, part and sig, its smallest hashes."""
    w = items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("item_id"), words(F.col(text)).alias("w")).distinct()
    made = w.where(F.size("w") > 0).select("item_id", shingle_texts(F.col("w"), width).alias("shingles"), F.array_sort(F.array_distinct(shingle_hashes(F.col("w"), width))).alias("h"))
    sized = made.withColumn("n", F.size("shingles")).withColumn("need", F.ceil(F.col("n") * percent / 100).cast("int"))
    return sized.withColumn("part", partition_of(F.col("n"))).withColumn("sig", F.slice("h", 1, F.col("n") - F.col("need") + 1)).drop("h")


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """The frame, marked for broadcast if its row count is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_key(text: str) -> list[Column]:
    """Names a text among all; only narrows a search that is then verified, or joins verified texts."""
    return [F.xxhash64(text).alias("__k"), F.length(text).alias("__n")]


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of docs and item it contains: keep, item_id, n_item, n_shared, containment and the text's key.

    The candidate search moves only hashes. Texts of candidates are verified where they are scanned
    unless there are more candidates than may be broadcast.
    """
    ensure_checkpoints(docs.sparkSession)
    index = item_index(items, width, percent).checkpoint()
    sig = index.select("part", "item_id", F.explode("sig").alias("h"))
    bounds = {r[0]: (r[1], r[2]) for r in sig.groupBy("part").agg(F.max("h"), F.count("*")).collect()}  # a row for each partition
    n_sig = sum(n for _, n in bounds.values())
    texts = docs.where(F.col(text).isNotNull())
    most = F.lit(max((m for m, _ in bounds.values()), default=-(2**63)))
    low = F.filter(shingle_hashes(F.col("__w"), width), lambda h: h <= most)
    hashes = texts.select(*text_key(text), words(F.col(text)).alias("__w")).select("__k", "__n", F.explode(low).alias("h"))
    # A hash is looked up in the partitions whose bound it doesn't pass, and only there.
    asked = F.array_compact(F.array(F.lit(None).cast("int"), *(F.when(F.col("h") <= m, F.lit(part)) for part, (m, _) in sorted(bounds.items()))))
    probes = hashes.select("__k", "__n", "h", F.explode(asked).alias("part"))
    pairs = probes.join(small_enough(sig, n_sig), ["part", "h"]).select("__k", "__n", "item_id").distinct().checkpoint()
    found = texts.select(*keep, *text_key(text), F.col(text).alias("__text")).join(small_enough(pairs, pairs.count()), ["__k", "__n"])
    facts = index.select("item_id", "shingles", "need", F.col("n").alias("n_item"))
    n_facts = index.agg(F.sum("n")).first()[0] or 0  # shingles of all items
    split = found.withColumn("__w", words(F.col("__text"))).drop("__text")  # a column, as an expression inside a lambda is worked out for each shingle
    rows = split.join(small_enough(facts, n_facts), "item_id").withColumn("n_shared", F.size(F.array_intersect("shingles", shingle_texts(F.col("__w"), width))))
    return rows.where(F.col("n_shared") >= F.col("need")).select(*keep, "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"), "__k", "__n")


def without_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """docs without the rows whose text contains an item."""
    found = matches(docs, items, width, percent, text, keep=()).select("__k", "__n").distinct().checkpoint()
    gone = small_enough(found, found.count())
    named = docs.select("*", *text_key(text))
    return named.join(gone, ["__k", "__n"], "left_anti").drop("__k", "__n")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item of which it holds 80 of 100 shingles."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", F.col("n_item").cast("long"), F.col("n_shared").cast("long"), "containment")


_WORDS_SQL = r"list_filter(regexp_split_to_array(lower({0}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_SET_SQL = """list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES = {
    "op6_decontamination": f"""
WITH dw AS (SELECT doc_id, {_WORDS_SQL.format("text")} AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, {_WORDS_SQL.format("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
ds AS (SELECT row_number() OVER () AS rid, doc_id, {_SET_SQL} AS s FROM dw WHERE len(w) > 0),
its AS (SELECT item_id, {_SET_SQL} AS s FROM iw WHERE len(w) > 0),
di AS (SELECT rid, doc_id, unnest(s) AS g FROM ds),
ii AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM its),
hit AS (SELECT rid, doc_id, item_id, n, count(*) AS shared FROM di JOIN ii USING (g) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item, CAST(shared AS BIGINT) AS n_shared, shared / n AS containment
FROM hit WHERE shared * 100 >= n * 80"""
}
