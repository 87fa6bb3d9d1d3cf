"""Language ID by nearest centroids of TF-IDF character n-grams, with rejection by distance.

A text becomes its lower-cased letters, other runs one space. Its n-grams of 1 to 3 characters
are hashed into BUCKETS; the square roots of their counts times the inverse document frequency,
normalised to length 1, are its vector. Every learned language has several centroids (spherical
k-means from a bounded sample of its documents), and a text belongs to the language of the
centroid with the largest cosine. Document frequencies count all documents that may be learned
from. A text is rejected if its largest cosine is below what its language shows at about its length:
SLACK times the QUANTILE of the cosines of sampled documents that the centroids were not fitted on
(every HOLD-th of the sample), from the nearest lengths that ENOUGH of them have.

Null texts and texts without a letter are `und`, with score 0, and rejected. With nothing to learn
from, everything is `und`. Equal cosines go to the language first in the alphabet. Repeated rows
repeat; columns other than the id, the text and lang are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, in_fold, map_texts, table

FOLDS, HELD_OUT = 3, 1
BUCKETS, CENTROIDS = 1 << 13, 4
#: The sample that centroids are fitted on: documents of each language and of all, characters in each, and the most frequent languages that are learned.
SAMPLE, SAMPLE_OF_ALL, MAX_CHARS, LANGUAGES = 800, 8_000, 20_000, 256
SLACK, QUANTILE, HOLD, ENOUGH, LENGTH_BINS = 0.6, 0.01, 3, 20, 24
#: Characters of a chunk, and rows of one whose vectors are dense.
AT_ONCE, ROWS_AT_ONCE = 250_000, 128
UND = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the index of each one's text, and each text's number of letters."""
    raw = ["\n" + t.lower() + "\n" for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    points = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(raw)), sizes)
    letter = _letters()[points]
    n_letters = np.bincount(doc[letter], minlength=len(raw))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    keep[:-1] |= letter[1:] & ~letter[:-1] & (doc[1:] == doc[:-1]) & ~keep[:-1]
    points, doc = np.where(letter, points, 32)[keep], doc[keep]
    h, out, who = points.astype(np.uint32), [], []
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) + points[n - 1 :].astype(np.uint32)
            whole = doc[: len(h)] == doc[n - 1 :] if len(h) else np.empty(0, bool)
            m = (h[whole] + np.uint32(n)) * np.uint32(0x9E3779B1)
            m = (m ^ (m >> np.uint32(15))) * np.uint32(0x85EBCA77)
            out.append((m >> np.uint32(32 - 13)).astype(np.int64))
            who.append(doc[: len(h)][whole])
    return np.concatenate(out), np.concatenate(who), n_letters


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat, who, n_letters = grams(texts)
    return np.bincount(who * BUCKETS + flat, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS), n_letters


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tf, n_letters = counts(texts)
    v = np.sqrt(tf).astype(np.float32) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1), n_letters


def length_bin(n_letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_letters, 1)).astype(np.int64), LENGTH_BINS - 1)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a row each
    owner: np.ndarray  # the language of each row
    floor: np.ndarray  # the least cosine accepted, by language and length bin

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        langs, scores, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        for lo, hi in chunks(texts, AT_ONCE, ROWS_AT_ONCE):
            v, n_letters = vectors(texts[lo:hi], self.idf)
            if not len(self.owner):
                langs += [UND] * (hi - lo)
                continue
            cosine = v @ self.centroids.T
            best = cosine.argmax(axis=1)
            top = np.clip(cosine[np.arange(hi - lo), best], 0, 1)
            lang, known = self.owner[best], n_letters > 0
            scores[lo:hi] = np.where(known, top, 0)
            rejected[lo:hi] = ~known | (top < self.floor[lang, length_bin(n_letters)])
            langs += [self.languages[i] if k else UND for i, k in zip(lang, known, strict=True)]
        return langs, scores, rejected


def floors(cosines: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The least cosine accepted for each length bin, from the bins around it that hold ENOUGH texts together; 0 without any."""
    out = np.zeros(LENGTH_BINS)
    for b in range(LENGTH_BINS):
        apart = np.abs(bins - b)
        for reach in range(LENGTH_BINS):
            near = cosines[apart <= reach]
            if len(near) >= min(ENOUGH, len(cosines)):
                break
        if len(near):
            out[b] = SLACK * np.quantile(near, QUANTILE)
    return out


def cluster(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: up to k unit centroids of unit vectors."""
    at = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        near = (v @ at.T).argmax(axis=1)
        at = np.stack([v[near == j].mean(axis=0) if (near == j).any() else at[j] for j in range(len(at))])
        at /= np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)
    return at


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many of all the texts each bucket stands, and the number of texts. A task sends one row for each bucket it has met."""

    def run(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for lo, hi in chunks(texts, AT_ONCE):
                flat, who, _ = grams(texts[lo:hi])
                df += np.bincount(np.unique(who * BUCKETS + flat) % BUCKETS, minlength=BUCKETS)
                n += hi - lo
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows at most
    df, n = np.zeros(BUCKETS, np.int64), 0
    for bucket, m in rows:
        if bucket < 0:
            n = m
        else:
            df[bucket] = m
    return df, n


def fit_languages(docs: DataFrame, learn_from: Column, per_language: int = SAMPLE, max_chars: int = MAX_CHARS, k: int = CENTROIDS, seed: int = 11) -> LanguageModel:
    """docs: doc_id, text, lang. Learns from rows that meet the condition and have id, text and lang.

    Of more than LANGUAGES values of lang the most frequent are learned; all languages together are
    sampled by at most SAMPLE_OF_ALL documents, or one each.
    """
    usable = docs.select("doc_id", "text", "lang").where(learn_from & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    df, n = document_frequencies(usable, "text")
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    short = usable.where(F.length("text") <= max_chars)
    sizes = short.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    per_language = min(per_language, max(1, SAMPLE_OF_ALL // max(1, len(sizes))))
    # A hash bound leaves about four times as many rows as wanted before anything is sorted.
    bound = [(lang, int(min(2**63 - 1, -(2**63) + 4 * max(per_language, 250) / m * 2**64))) for lang, m in sizes]
    order = F.xxhash64("doc_id")
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bound, "lang string, __most long"))  # LANGUAGES rows at most
    first = Window.partitionBy("lang").orderBy(order, "doc_id")
    few = short.select("doc_id", "lang").join(bounds, "lang").where(order <= F.col("__most")).withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= per_language)
    picked = F.broadcast(few.select("doc_id", "lang").distinct())  # SAMPLE_OF_ALL ids at most
    rows = short.join(picked, ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang"]).select("doc_id", "lang", "text").collect()
    by: dict[str, list] = {}
    for doc_id, lang, text in sorted(rows, key=lambda r: (r[1], r[0])):
        by.setdefault(lang, []).append(text)
    rng = np.random.default_rng(seed)
    languages, centroids, owner, least = sorted(by), [], [], []
    for i, lang in enumerate(languages):
        made = [vectors(by[lang][lo:hi], idf) for lo, hi in chunks(by[lang], AT_ONCE, ROWS_AT_ONCE)]
        v, n_letters = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
        v, n_letters = v[n_letters > 0], n_letters[n_letters > 0]
        floor = np.zeros(LENGTH_BINS)
        if len(v):
            apart = np.arange(len(v)) % HOLD == HOLD - 1
            at = cluster(v[~apart], k, rng)
            centroids.append(at)
            owner += [i] * len(at)
            floor = floors((v[apart] @ at.T).max(axis=1), length_bin(n_letters[apart])) if apart.any() else floor
        least.append(floor)
    return LanguageModel(languages, idf, np.concatenate(centroids) if centroids else np.zeros((0, BUCKETS), np.float32), np.array(owner, np.int64), np.array(least).reshape(-1, LENGTH_BINS))


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score (the cosine) and rejected; a map over rows with the model broadcast (its size follows the number of languages)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        return lambda texts: model.predict(texts)

    return map_texts(docs, text, PREDICTED, make, keep if keep is not None else [c for c in docs.columns if c not in (text, "lang_pred", "score", "rejected")])


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, ~in_fold("doc_id", FOLDS, HELD_OUT))
    return predict_languages(docs, model, keep=["doc_id"]).select("doc_id", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op4_langid": op4_langid}
ORACLES: dict[str, str] = {}
