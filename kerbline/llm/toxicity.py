"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

The model learns from a bounded sample of labelled documents (SAMPLE of the labels 0 and 1, of at most
MAX_CHARS characters) and scores every whole text. Null and empty texts get the score of an empty
bag; repeated rows repeat; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, table
from .subword import Model, Shape, labelled_sample, score_texts, train

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
SAMPLE, MAX_CHARS = (2400, 1600), 20_000
SHAPE = Shape(bits=18, dim=8, shortest=3, longest=5, fold_case=True, damp=True)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE, max_chars: int = MAX_CHARS) -> Model:
    rows, prior = labelled_sample(docs, labels, "toxic", ~in_fold("doc_id", FOLDS, HELD_OUT), per_class, max_chars)
    return train(rows, SHAPE, prior, fragments=2)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all but the text by default) and score, the chance of label 1."""
    return score_texts(docs, model, text, keep if keep is not None else [c for c in docs.columns if c not in (text, "score")])


def verdicts(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scored.select("doc_id", in_fold("doc_id", folds, held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verdicts(score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), keep=["doc_id"]), FOLDS, HELD_OUT)


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
