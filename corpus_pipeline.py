"""Corpus preparation in five stages: quality, toxicity, near duplicates, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldstats.llm import decontaminate, encoding, jaccard, quality_model, toxicity
from fieldstats.llm.queries import vocabulary_path
from fieldstats.llm.store import load, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on labelled rows among docs."""
    return quality_model.keep(docs, quality_model.fit(docs, load(spark, sf_dir, "labels")))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold."""
    return toxicity.keep(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard.dedupe(docs, 5, 80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the text decoded from them."""
    return encoding.digests(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality),
    ("toxicity", harmless),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", uncontaminated),
    ("BPE encoding and decoding", encoded),
]

#: The classifiers and the encoder cannot be written in SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each on what the one before kept, written as Parquet in between."""
    docs = load(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
