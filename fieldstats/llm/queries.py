"""Registered queries of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from fieldstats.llm import decontaminate, encoding, fim, jaccard, katz, language, negatives, oracles, quality_model, quality_rules, shards, simhash, token_counts, toxicity
from fieldstats.llm.store import load


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(load(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class id and number of links of each document."""
    return jaccard.join(load(spark, sf_dir, "documents"), 3, 90, counts=True)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.digests(load(spark, sf_dir, "documents"), vocabulary_path())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(load(spark, sf_dir, "documents"), vocabulary_path())


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, load(spark, sf_dir, "labels")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents")).drop("host")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(load(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host: source) and pages in one result; the id of the other kind is null."""
    docs = load(spark, sf_dir, "documents")
    model = language.fit_text(docs)
    documents = language.document_records(docs, model).withColumns({"doc_id": F.col("id"), "page_id": F.lit(None).cast("long")})
    pages = language.page_records(load(spark, sf_dir, "pages"), model).withColumns({"doc_id": F.lit(None).cast("long"), "page_id": F.col("id")})
    return language.identify(documents.unionByName(pages), model).drop("id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are a hundredth of the rows; every seventh row has its label moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.quantised(load(spark, sf_dir, "embeddings"), label), F.col("id") % 100 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(load(spark, sf_dir, "documents"))


def op13_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.join(load(spark, sf_dir, "documents"), 3, 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": oracles.OP2_LINKS, "op8_quality_rules": oracles.OP8, "op11_hard_negatives": oracles.OP11, "op12_fill_in_middle": oracles.OP12}
