"""From documents to token ids: language, quality, near-duplicates, mixing, BPE.

Every stage is a function (spark, docs, folder of the given tables) -> DataFrame; what it returns is
written and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.llm import bpe, langid, mixing, neardup, repetition
from rowkin.llm.registry import MIX_TARGETS, domain_labels, vocabulary
from rowkin.llm.tables import given, remainder
from rowkin.session import stage


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language can be told; a quarter is held out from learning."""
    return langid.keep_identified(docs, langid.train(docs.where(remainder("doc_id", 4) != 2)))


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that do not repeat themselves and are long enough."""
    return repetition.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as their rate for the target weights says."""
    return mixing.take(docs, domain_labels(given(spark, folder, "labels")), MIX_TARGETS, words=True)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    encoded = bpe.encode(docs, vocabulary())
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

# Fitted classifiers, rates and a vocabulary are beyond SQL; tests/llm checks the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = given(spark, folder, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
