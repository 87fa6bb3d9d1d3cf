"""License scans: phrases found anywhere, and notices found by an exact set-similarity join.

Native: DataFrame functions only. Words are runs of ASCII letters and digits and all characters
beyond ASCII, A-Z in lower case. PHRASES are counted wherever their words stand consecutively,
across lines too. The notices of TEMPLATES are token sets; a block of text is a line, and a
block's label is that of each template of which at least PERCENT of 100 distinct tokens are in it.

The join: a template with n tokens needs an overlap of o = ceil(n * PERCENT / 100). Tokens are
ordered by how many blocks of the whole corpus hold them, the rarest first, ties by the token. Length filter: a
block needs o tokens of the templates' vocabulary. Prefix filter: an overlap of o shows within
the first n - o + 1 template tokens and the first m - o + 1 of the block's m vocabulary tokens.
Positional filter: a match at places i and k leaves at most 1 + min(n - i, m - k) common tokens.
What passes is verified by the full intersection, so the result is exact.

Null and empty texts have no words, no labels and score 0. Repeated rows repeat. Blocks are tied to
their text by a 256-bit hash, so nulls or repeats in doc_id change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoints, table

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices and their labels.
TEMPLATES = {
    "all rights reserved": "all-rights-reserved",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0-notice",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "released under the mit license": "mit-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0-notice",
    "this program is free software you can redistribute it and or modify it under the terms": "gpl-grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
PERCENT = 80
OTHERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """The lower-cased words with one space before, between and after them; one space without words."""
    # Beyond A-Z, lower() changes no word into a phrase: no other letter becomes one of theirs.
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), OTHERS, " ")


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_columns(n: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and the labels of phrases, from normal text."""
    text = {p: F.lit(f" {p} ") for p in PHRASES}
    held = {p: n.contains(text[p]) for p in PHRASES}
    count = {p: F.when(held[p], F.regexp_count(n, F.lit(f" {p}(?= )"))).otherwise(0) for p in PHRASES}
    first = F.least(*(F.when(held[p], F.instr(n, f" {p} ")) for p in PHRASES))
    tail = {p: F.when(held[p], F.length(F.substring_index(F.concat(n, F.lit("")), f" {p} ", -1))) for p in PHRASES}
    # substring_index leaves what follows the last place; overlapping places share only a space and can't hide a later one
    last = F.greatest(*(F.when(held[p], F.length(n) - tail[p] - len(p) - 1) for p in PHRASES))
    before = lambda at: spaces(F.substring(n, F.lit(1), at)) - 1
    any_held = F.greatest(*held.values())
    return {
        "n_words": (spaces(n) - 1).cast("long"),
        "n_base": sum(count.values(), F.lit(0)).cast("long"),
        "first_word": F.when(any_held, before(first)).cast("long"),
        "last_word": F.when(any_held, before(last)).cast("long"),
        "base": F.array_compact(F.array(*(F.when(held[p], label) for p, label in PHRASES.items()))),
    }


def templates(spark, given: dict[str, str], percent: int) -> DataFrame:
    """A row for each template: label, tokens, n and o; their number and length are fixed by the caller."""
    rows = [(label, sorted(set(text.split())), len(set(text.split())), -(-len(set(text.split())) * percent // 100)) for text, label in given.items()]
    return spark.createDataFrame(rows, "label string, tokens array<string>, n int, o int")


def notices(docs: DataFrame, given: dict[str, str] = TEMPLATES, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """key (the text's SHA-256), labels and best (the largest containment) for each text with a notice."""
    spark = docs.sparkSession
    ensure_checkpoints(spark)
    found = templates(spark, given, percent)
    vocabulary = sorted({t for s in given for t in s.split()})
    least = min(-(-len(set(s.split())) * percent // 100) for s in given)
    known = F.array(*map(F.lit, vocabulary))
    # A text without a rare-in-prose word of the templates still passes: only the overlap decides.
    lines = docs.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("key"), F.explode(F.split(text, "\n")).alias("line"))
    blocks = lines.select("key", F.array_intersect(F.split(F.trim(normal(F.col("line"))), " "), known).alias("tokens"))
    held = blocks.where(F.size("tokens") > 0)
    frequency = {r[0]: r[1] for r in held.select(F.explode("tokens").alias("t")).groupBy("t").count().collect()}  # a row for each template token at most
    order = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t)), 1)}
    rank = F.create_map(*(x for t, i in order.items() for x in (F.lit(t), F.lit(i))))
    ranked = lambda c: F.array_sort(F.transform(c, lambda t: rank[t]))
    sets = held.where(F.size("tokens") >= least).select("key", ranked(F.col("tokens")).alias("b")).withColumn("m", F.size("b"))
    # The shortest prefix that serves every template is that of the least overlap.
    mine = sets.select("key", "b", "m", F.posexplode(F.slice("b", 1, F.col("m") - least + 1)).alias("k", "r"))
    theirs = found.select("label", "n", "o", ranked(F.col("tokens")).alias("t")).select("label", "n", "o", "t", F.posexplode(F.slice("t", 1, F.col("n") - F.col("o") + 1)).alias("i", "r"))
    pairs = mine.join(F.broadcast(theirs), "r").where((F.col("m") >= F.col("o")) & (F.col("k") <= F.col("m") - F.col("o")) & (1 + F.least(F.col("n") - 1 - F.col("i"), F.col("m") - 1 - F.col("k")) >= F.col("o")))
    checked = pairs.withColumn("common", F.size(F.array_intersect("b", "t"))).where(F.col("common") >= F.col("o"))
    return checked.groupBy("key").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.col("n")).alias("best"))


def license_scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs.

    score: 1 if a phrase is found, else the largest containment of a template among the notices found, else 0.
    """
    cols = phrase_columns(F.col("__normal"))
    base = docs.select(*keep, F.sha2(text, 256).alias("key"), normal(F.coalesce(text, F.lit(""))).alias("__normal")).select(*keep, "key", *(c.alias(k) for k, c in cols.items()))
    rows = base.join(notices(docs.select(text), text=text), "key", "left")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select(
        *keep,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    words = r"list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    phrases = " UNION ALL ".join(f"SELECT '{p}' AS phrase, {len(p.split())} AS size, '{label}' AS label" for p, label in PHRASES.items())
    rows = ", ".join(f"('{label}', list_distinct(string_split('{t}', ' ')))" for t, label in TEMPLATES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, {words.format("text")} AS w FROM d),
p AS ({phrases}),
spots AS (SELECT rid, label, i FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM w) JOIN p ON array_to_string(w[i:i + size - 1], ' ') = phrase),
b AS (SELECT rid, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS base FROM spots GROUP BY rid),
t(label, tokens) AS (VALUES {rows}),
l AS (SELECT rid, list_distinct({words.replace("translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "lower({0})").format("line")}) AS tokens FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
n AS (SELECT rid, label, len(list_intersect(t.tokens, l.tokens)) AS common, len(t.tokens) AS n FROM l CROSS JOIN t),
m AS (SELECT rid, list(DISTINCT label) AS found, max(common / n) AS best FROM n WHERE common * 100 >= n * {PERCENT} GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
  CASE WHEN base IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)"""


QUERIES = {"op1_licenses": op1_licenses}
ORACLES = {"op1_licenses": _sql()}
