"""From raw documents to token digests: five stages, each a table for the next.

Every stage but the last takes and returns the columns of documents (the secret scan changes texts, the mix repeats rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.staging import stage
from corpusloom.llm import bpe, language, mixing, ngram_join, secrets

#: A document is kept if one language holds at least this share of its words.
LEAST_SCORE = 0.4

#: Near copies: sets of so many words' shingles with at least this Jaccard similarity, in percent.
WORDS, PERCENT = 5, 80


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a leading language, go."""
    return language.keep_identified(docs, LEAST_SCORE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays."""
    return ngram_join.keep_one(docs, WORDS, PERCENT)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials give way to a mark in the text."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, or up to three times."""
    taken = mixing.mix(docs, keep=docs.columns)
    return taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("language_id", identify),
    ("ngram_jaccard_join", deduplicate),
    ("secret_scan", redact),
    ("source_mix", mix),
    ("byte_level_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language identification, joins by classes and tokenising have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None
