"""Quality: learned hashed word and character n-gram vectors averaged per document, softmax output.

Tokens keep their case and punctuation, and adjacent tokens form word pairs. Trained by numpy
stochastic gradient descent on a bounded sample of labelled documents (SAMPLE of each label, of at
most MAX_CHARS characters); every whole text is scored. Null and empty texts get the score of an
empty bag; repeated rows repeat; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .common import in_fold, table
from .subword import Model, Shape, labelled_sample, score_texts, train
from .toxicity import verdicts

FOLDS, HELD_OUT = 5, 0
SAMPLE, MAX_CHARS = (1500, 1500), 20_000
SHAPE = Shape(bits=18, dim=8, shortest=1, longest=4, fold_case=False, pairs=True)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE, max_chars: int = MAX_CHARS) -> Model:
    rows, prior = labelled_sample(docs, labels, "quality", ~in_fold("doc_id", FOLDS, HELD_OUT), per_class, max_chars)
    return train(rows, SHAPE, prior)


def score_quality(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all but the text by default) and score, the chance of label 1."""
    return score_texts(docs, model, text, keep if keep is not None else [c for c in docs.columns if c not in (text, "score")])


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verdicts(score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), keep=["doc_id"]), FOLDS, HELD_OUT)


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
