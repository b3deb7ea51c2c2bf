"""The registered queries of this folder; their SQL twins are in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicloom.llm import (
    decontaminate,
    embedding_pairs,
    filter_audit,
    licenses,
    mixing,
    ngram_jaccard,
    ngram_lm,
    periodic_runs,
    quality,
    substrings,
    token_shards,
    toxicity,
    warc,
)
from topicloom.llm.tables import table


def op1_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_lm.train_and_score(table(spark, folder, "documents"))


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard.shingle_components(table(spark, folder, "documents"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents")).drop("kept")


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op5_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    return token_shards.write_shards(table(spark, folder, "documents"))


def op6_embedding_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_pairs.vector_links(table(spark, folder, "embeddings"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_digest(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_lm_score, op2_ngram_jaccard, op3_substring_dedup, op4_warc, op5_token_shards, op6_embedding_pairs,
    op7_decontamination, op8_quality, op9_mixing, op10_licenses, op11_filter_audit, op12_toxicity,
    op13_periodic_runs,
)}
