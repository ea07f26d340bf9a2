"""From raw documents to encoded training data in five stages, each written and read again.

Every stage works on all that the one before kept.  All but the last return the
columns of ``documents``; the last returns each document's ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from voxelloom.llm import digests, langid, mixing, nearjoin, unigram
from voxelloom.plans.saving import drop_saved, saved, written
from voxelloom.shipping import shipped

#: A document goes if its likeliest language is less likely than this.
LEAST_SCORE = 0.3


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipping(stage: Stage) -> Stage:
    """Executors get the sources first."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shipped(spark)
        return stage(spark, docs, sf_dir)

    return run


@_shipping
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is null or has no letter go, and those of which no known language is likely.

    Languages are learned from all rows with both text and lang; where there is none, all
    texts with a letter stay.  Ties between languages go by code point.  Of repeated rows
    all stay or none; null ids and other columns don't matter and are kept as they are;
    very long texts are read whole; an empty table gives none.
    """
    return langid.identified_rows(docs, LEAST_SCORE)


@_shipping
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id stays.

    Null texts are empty, and one of them stays; a null id counts as the smallest; of rows
    that repeat id and text one stays.  Very long texts are read whole; all columns are
    kept as they are; an empty table gives none.
    """
    with digests.passing_index(spark) as index:
        return digests.kept_rows(docs, index)


@_shipping
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the one with the smallest doc_id stays.

    Links may go over other documents.  Null and empty texts are linked with each other
    only; null ids are after all others; of different texts of one id the one of least
    hash stays, and rows that repeat it stay as often as they come.  Very long texts are
    read whole; all columns are kept as they are; an empty table gives none.
    """
    return nearjoin.first_rows(docs)


@_shipping
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at each source's cut is shortened to meet the budget.

    A null source is a source of its own; null and empty texts have no words and go with
    the whole epochs of their source.  Documents are ordered by a hash of their id, then by
    id, size and a hash of the text; which of rows that repeat id and text is cut is open.
    Very long texts are counted whole; all columns are kept as they are, but for text and
    n_chars of the cut one; an empty table gives none.
    """
    return mixing.mixed_rows(docs)


@_shipping
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document.

    Null and empty texts have none; repeated rows and null ids are kept as they come; very
    long texts are taken whole; an empty table gives none.
    """
    return unigram.op8_sentencepiece(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage has saved on the way goes once its result is written."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        drop_saved(spark, since, but_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
