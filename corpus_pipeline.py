"""From raw documents to sharded training text, one corpus operator a stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepwright.llm import decontaminate, mixing, quality, sharding, simhash
from stepwright.llm.common import shared_dir, table

SHARDS = 16


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; it learns from the labelled ones among docs and a sample of all.

    Null and empty texts are scored as texts without any feature, very long ones whole; repeated rows share a fate, null ids
    are scored and not learnt from. Columns and their names stay as they are; no rows give none.
    """
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a similarity of 0.8 or more: that of the least doc_id.

    Null ids come last, of repeated rows one stays; null and empty texts are copies of each other. Very long texts are compared
    whole. Columns and their names stay as they are; no rows give none.
    """
    return simhash.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none, very long ones are searched whole; rows are judged each by its own text, whatever their
    doc_id. Columns and their names stay as they are; no rows give none.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most.

    Null and empty texts have no words and are never taken; null sources are one source; repeated rows are taken each by
    itself. Columns and their names stay as they are; no rows give none.
    """
    return mixing.mixed_documents(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Null texts have size 1, null ids share a shard; repeated rows have slots of their own. Other columns are left out; no rows
    give none.
    """
    return sharding.shard(docs, sharding.tree(SHARDS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("source_mix", mix_sources),
    ("sharding", to_shards),
]

#: The classifier and the fingerprints have no SQL form; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
