"""The corpus pipeline: language ID, toxicity, near-duplicates, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, the last one digests of token ids and
all others rows of docs with the columns of documents. Rows without a doc_id pass the near-duplicate
stage; null and empty texts are rejected by the first stage, which finds no letter in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import bpe, decontam, langid, neardup, toxicity
from kerbline.llm.common import ensure_checkpoints, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject."""
    model = langid.fit_languages(docs, F.lit(True))
    return langid.predict_languages(docs.withColumn("__body", F.col("text")), model, "__body", docs.columns).where(~F.col("rejected")).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold of toxicity."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.withColumn("__body", F.col("text")), model, "__body", docs.columns)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, a similarity of 0.8 or more."""
    return neardup.keep_one(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digests(bpe.encode_decode(docs, bpe.vocabulary(), keep=["doc_id"]), "doc_id")


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are checkpointed before the next reads them."""
    ensure_checkpoints(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = docs.checkpoint()
    return docs
