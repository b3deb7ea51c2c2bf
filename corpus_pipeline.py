"""A corpus from raw documents to token shards: five stages, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import decontaminate, mixing, ngram_jaccard, quality, token_shards
from topicloom.llm.tables import table
from topicloom.session import RunFolder, bounded_batches

# No SQL: a trained classifier, random rounding and a tokenizer are not expressible; see tests/llm.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(take: Stage) -> Stage:
    """A stage whose Python workers get few texts at once."""

    @wraps(take)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return take(spark, docs, sf_dir)

    return staged


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@_stage
def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id; one without an id only if none has one.

    Rows are told apart by a key of their own, so repeated rows are a group, and an id that stands on
    several texts has each of them decided by itself.
    """
    folder = RunFolder(spark, "groups")
    # the row is one value, so that no column of it can meet the key
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = folder.write(docs.select(F.monotonically_increasing_id().alias("row_key"), whole), "rows")
    texts = rows.select("row_key", F.col("row.text").alias("text"))
    found = ngram_jaccard.shingle_components(texts, doc_id="row_key").select(F.col("doc_id").alias("row_key"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    ids = rows.select("row_key", F.col("row.doc_id").alias("doc_id"))
    kept = found.join(ids, "row_key").groupBy("component_id").agg(first.alias("first"))
    keep = folder.write(kept.select("first.row_key"), "kept")
    return rows.join(keep, "row_key", "left_semi").select("row.*")


@_stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items taken out; documents that are mostly such passages go."""
    clean = decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(docs, RunFolder(spark, "mixed").write(mixing.mix(docs), "mix"))


@_stage
def token_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-length token sequences in training order, read from their shards."""
    return token_shards.write_shards(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_per_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("token shards", token_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = RunFolder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = folder.write(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
