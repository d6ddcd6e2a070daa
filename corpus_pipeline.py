"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, mixing, ngram_join, quality, toxicity
from quarry.llm.common import materialize, release, table, tune
from quarry.llm.labelled import score_column


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents whose toxicity reaches the threshold go. The model learns from the labelled documents."""
    tune(spark)
    machine = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(score_column(machine, F.col("text")) < toxicity.THRESHOLD)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose quality is below the threshold go."""
    tune(spark)
    voters = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(score_column(voters, F.col("text")) >= quality.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near copies (five words, similarity 0.8 or more) the first document stays."""
    return ngram_join.one_of_each(docs, 5, 80, 100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents are taken as often as the mix of their sources asks for."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token counts and digests of what is left; a document that the mix repeats has a row each time."""
    tune(spark)
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Trained models and sentencepiece have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if done is not documents:
            release(done)
    return STAGES[-1][1](spark, docs, sf_dir)
