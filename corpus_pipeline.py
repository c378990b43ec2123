"""Quality, language, near duplicates, packing: a corpus from documents to sequences.

A stage returns a lazy result of tables that operators wrote on the way; write it before anything else deletes them. run() writes
each stage's result and then deletes that stage's tables, and no others: pipelines in one process don't touch each
other's. Tables of stages called on their own, and those that the last result reads, stay until their folder is cleaned, or
until the block of strataframe.llm.common.tables() ends in which they were called.

Defined results: null texts are empty ones: their quality is scored, and the language stage drops them with all others
without a letter; null keys are kept as keys; of rows that are equal in text one stays, that with the smallest key (a null key
after all others); repeated keys with different texts all stay; an empty table gives an empty table; extra columns of any
name and type, also those that operators use themselves, are carried through the first three stages unchanged; packing returns
only its own columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import jaccard, langid, packing, quality
from strataframe.llm.common import free, materialize, tables

#: The least share of letters that one language must hold.
LANGUAGE_SHARE = 0.5
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, learnt from the labels, reaches the threshold."""
    ranker = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free(docs, "score")
    return quality.score(docs, ranker, keep=True, into=score).where(F.col(score) >= quality.CUT).select(*docs.columns)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, at least LANGUAGE_SHARE of them in spans of one language."""
    lang, score, spans = (free(docs, c) for c in ("lang_pred", "score", "spans"))
    seen = langid.label(docs, langid.train(docs), into=(lang, score, spans))
    return seen.where((F.col(lang) != "und") & (F.col(score) >= LANGUAGE_SHARE)).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return jaccard.distinct(docs, width=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens in sequences."""
    import public_tokenizers

    return packing.digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good), ("language", in_a_language), ("near duplicates", without_copies), ("packing", packed)]
#: Learnt scores and merges of a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        with tables(spark):
            made = step(spark, docs, sf_dir)
            docs = materialize(made, f"stage-{name.replace(' ', '-')}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
