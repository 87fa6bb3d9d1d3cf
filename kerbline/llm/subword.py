"""Supervised subword embeddings in numpy, shared by the toxicity and quality classifiers.

A document is a bag of units: one for each token, the mean of the hashed vectors of the token
and of its character n-grams, and, if asked for, one for each pair of adjacent tokens (two equal
tokens share one vector of repetition). The units are averaged and a linear softmax over the mean
gives the score. Vectors and softmax are trained jointly by stochastic gradient descent with
per-row step sizes. Since all is linear before the softmax, scoring only adds one number for each
unit, so unseen spellings are scored by the character n-grams that they share with known ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_of, map_texts

STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—"
#: Features of the training sample kept at once; at 4 bytes each that bounds its memory, whatever the texts' lengths.
MOST_FEATURES = 24_000_000
#: Distinct tokens whose scores a worker keeps before it starts anew.
CACHE_ENTRIES = 150_000
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Shape:
    """What a unit is. fold_case: lower case, punctuation at the ends left out.
    damp: a token that stands n times in a document counts as the root of n units."""

    bits: int = 18
    dim: int = 8
    shortest: int = 3
    longest: int = 5
    fold_case: bool = True
    pairs: bool = False
    damp: bool = False


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * P1
    return (h ^ (h >> np.uint64(32))) * P2


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def subwords(tokens: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all subwords, the index of each one's token, and a 64-bit hash of each token."""
    if shape.fold_case:
        tokens = [t.lower().strip(STRIP) for t in tokens]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 2
    points = np.frombuffer("".join(["<" + t + ">" for t in tokens]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(tokens)), sizes)
    left = ends[owner] - np.arange(len(points))
    with np.errstate(over="ignore"):
        place = (np.arange(len(points)) - starts[owner]).astype(np.uint64)
        whole = mix(np.add.reduceat(mix(points + (place << np.uint64(32))), starts)) if len(tokens) else np.empty(0, np.uint64)
        out, who, h = [bucket(whole + P2, shape.bits)], [np.arange(len(tokens))], points
        for n in range(2, shape.longest + 1):
            h = h[:-1] * P1 + points[n - 1 :]
            if n >= shape.shortest:
                fits = left[: len(h)] >= n
                out.append(bucket(h[fits] + np.uint64(n), shape.bits))
                who.append(owner[: len(h)][fits])
    return np.concatenate(out), np.concatenate(who), whole


def pair_buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of adjacent tokens; equal neighbours share bucket 0."""
    a, b = hashes[:-1], hashes[1:]
    with np.errstate(over="ignore"):
        return np.where(a == b, 0, bucket(a * P1 + b, bits))


def features(text: str, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The document's distinct buckets and their weights in the average; both empty without tokens."""
    tokens = text.split()
    if not tokens:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(t, len(index)) for t in tokens])
    flat, who, hashes = subwords(list(index), shape)
    count, parts = np.bincount(ids), np.bincount(who)
    count = np.sqrt(count) if shape.damp else count
    weight = (count / parts)[who]
    units = count.sum()
    if shape.pairs and len(tokens) > 1:
        pairs = pair_buckets(hashes[ids], shape.bits)
        flat, weight, units = np.concatenate([flat, pairs]), np.concatenate([weight, np.ones(len(pairs))]), units + len(pairs)
    distinct, at = np.unique(flat, return_inverse=True)
    return distinct.astype(np.int32), (np.bincount(at, weight) / units).astype(np.float32)


def pieces(text: str, n: int, rng: np.random.Generator) -> list[str]:
    """n random runs of 4 to 40 tokens."""
    tokens, out = text.split(), []
    for _ in range(n):
        size = int(rng.integers(4, 41))
        at = int(rng.integers(0, max(1, len(tokens) - size + 1)))
        out.append(" ".join(tokens[at : at + size]))
    return out


class Bag:
    """Features of one document at 4 bytes each: gaps between sorted buckets, and weights in half precision times a scale."""

    __slots__ = ("gaps", "weights", "scale")

    def __init__(self, at: np.ndarray, w: np.ndarray):
        gaps = np.diff(at, prepend=0)
        self.gaps = gaps.astype(np.uint16 if gaps.max(initial=0) < 1 << 16 else np.int32)
        self.scale = np.float32(w.max(initial=0))
        self.weights = (w / self.scale if self.scale else w).astype(np.float16)

    def __len__(self) -> int:
        return len(self.gaps)

    def open(self) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.gaps, dtype=np.int64), self.weights.astype(np.float32) * self.scale


@dataclass
class Model:
    shape: Shape
    table: np.ndarray  # for each bucket, how far it moves the log odds of label 1
    bias: float
    gain: float
    spread: dict = field(default_factory=dict)


def train(rows: list[tuple[str, int]], shape: Shape, prior: float, epochs: int = 12, rate: float = 0.5, gain: float = 20.0, fragments: int = 0, seed: int = 7) -> Model:
    """Joint stochastic gradient descent, one document a step, in an order drawn from the seed.

    prior: label 1's share among all labelled rows; the sample's classes are weighted to it.
    fragments: so many short pieces of each document of label 0 join the sample as label 0; they keep
    the vectors of common words from adding up to a verdict on short texts.
    Rows are taken as long as their features are at most MOST_FEATURES together. Without rows of both labels the score is the prior.
    """
    rng = np.random.default_rng(seed)
    bags, taken, total = [], [], 0
    for t, label in rows:
        bag = Bag(*features(t, shape))
        if total + len(bag) > MOST_FEATURES:
            continue
        total += len(bag)
        bags.append(bag)
        taken.append((t, label))
    if fragments:
        taken += [(piece, 0) for t, label in taken if not label for piece in pieces(t, fragments, rng)]
        bags += [Bag(*features(t, shape)) for t, _ in taken[len(bags) :]]
        prior = prior / (1 + fragments * (1 - prior))
    y = np.array([label for _, label in taken], np.int64)
    share = y.mean() if len(y) else 0.0
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if not 0 < share < 1:
        return Model(shape, np.zeros(1 << shape.bits, np.float32), float(np.log(prior / (1 - prior))), gain)
    importance = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    vectors = (rng.random((1 << shape.bits, shape.dim), np.float32) - 0.5) / shape.dim * 0.1
    out = (rng.random((shape.dim, 2), np.float32) - 0.5).astype(np.float32)
    bias = np.log(np.array([1 - prior, prior], np.float32))
    seen_v, seen_o, seen_b = np.full(1 << shape.bits, 1e-6, np.float32), np.full(out.shape, 1e-2, np.float32), np.full(2, 1e-1, np.float32)
    steps, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            now = rate * (1 - steps / total)
            steps += 1
            at, w = bags[i].open()
            mean = gain * (w @ vectors[at]) if len(at) else np.zeros(shape.dim, np.float32)
            logits = mean @ out + bias
            e = np.exp(logits - logits.max())
            g = (e / e.sum()).astype(np.float32)
            g[y[i]] -= 1
            g *= np.float32(importance[i])
            d_out, d_mean = np.outer(mean, g), (out @ g) * gain
            seen_o += d_out**2
            seen_b += g**2
            if len(at):
                seen_v[at] += w**2 * (d_mean @ d_mean) / shape.dim
                vectors[at] -= (now * w / np.sqrt(seen_v[at]))[:, None] * d_mean
            out -= now * 0.2 * d_out / np.sqrt(seen_o)
            bias -= now * 0.2 * g / np.sqrt(seen_b)
    return Model(shape, (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), gain)


class Scorer:
    """Scores chunks of texts; keeps what it learns about tokens for later chunks."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.score, self.hash = np.empty(0, np.float32), np.empty(0, np.uint64)

    def _learn(self, tokens: list[str]) -> None:
        base = len(self.index)
        self.index.update(zip(tokens, range(base, base + len(tokens)), strict=True))
        flat, who, hashes = subwords(tokens, self.model.shape)
        new = np.bincount(who, self.model.table[flat], len(tokens)) / np.bincount(who, minlength=len(tokens))
        self.score = np.concatenate([self.score, new.astype(np.float32)])
        self.hash = np.concatenate([self.hash, hashes])

    def __call__(self, texts: list[str]) -> np.ndarray:
        runs = [t.split() for t in texts]
        new = set().union(*runs)
        if len(self.index) + len(new) > CACHE_ENTRIES:
            self._forget()
        new = [t for t in new if t not in self.index]
        if new:
            self._learn(new)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        ids = np.fromiter((self.index[t] for r in runs for t in r), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(runs)), sizes)
        if self.model.shape.damp:
            distinct, count = np.unique(doc * (1 + ids.max(initial=0)) + ids, return_counts=True)
            at, weight = distinct // (1 + ids.max(initial=0)), np.sqrt(count)
            total, units = np.bincount(at, self.score[distinct % (1 + ids.max(initial=0))] * weight, len(runs)), np.bincount(at, weight, len(runs))
        else:
            total, units = np.bincount(doc, self.score[ids], len(runs)), sizes.copy()
        if self.model.shape.pairs and len(ids) > 1:
            same = doc[:-1] == doc[1:]
            pairs = pair_buckets(self.hash[ids], self.model.shape.bits)[same]
            total += np.bincount(doc[:-1][same], self.model.table[pairs], len(runs))
            units += np.maximum(sizes - 1, 0)
        logit = self.model.gain * total / np.where(units > 0, units, 1) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def score_texts(df: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """Adds `score`; a map over rows with the model broadcast (its size is set by Shape.bits)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)
        return lambda texts: [scorer(texts)]

    return map_texts(df, text, T.StructType([T.StructField("score", T.DoubleType())]), make, keep)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn_from, per_class: tuple[int, int], max_chars: int) -> tuple[list[tuple[str, int]], float]:
    """Up to per_class[label] texts of each label, in the order of a hash of their ids, and label 1's share among all.

    docs: doc_id, text; labels: doc_id and the label (0 or 1, others and nulls left out; of
    several labels of a document the largest counts). learn_from: the condition on doc_id. Rows
    without an id or a text and texts of over max_chars aren't sampled. The ids are chosen from
    the labels first, so at most sum(per_class) ids are sent to the scan of the texts.
    """
    order = F.xxhash64("doc_id")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn_from).groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    counts = dict(known.groupBy("__label").count().collect())
    ids = [few_of(known.where(F.col("__label") == k), order, per_class[k], counts.get(k, 0)).orderBy(order, "doc_id").limit(per_class[k]) for k in (0, 1)]
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    rows = texts.orderBy(order, "doc_id", "text").limit(sum(per_class)).select("text", "__label").collect()
    total = sum(counts.values())
    return [(r[0], r[1]) for r in rows], counts.get(1, 0) / total if total else 0.5
