"""Corpus pipeline: the stages in order, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadence.llm import decontamination, language_id, sentencepieces, simhash, toxicity
from cadence.llm._common import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those that are ``und`` (null, or without a letter) go."""
    return language_id.identify(docs, language_id.fit(docs), keep=True)


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.classify(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=True)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return simhash.keep_one(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop=True)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and the decoded text of every document left."""
    return sentencepieces.encode_decode(docs)


STAGES = [("language_id", language), ("toxicity", ordinary), ("simhash_dedup", distinct), ("decontamination", unleaked), ("sentencepiece", pieces)]

#: No SQL: stages learn classifiers and align; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
