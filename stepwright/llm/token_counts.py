"""Token counts through a cache of content digests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, shared_dir, small_batches, stash, table
from .pieces import encoder

LIMIT = 512
CACHE_SCHEMA = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another file, or another version of it, shares no cached count."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content(text: Column) -> Column:
    """Normalised content: null is empty. Nothing else may change, or the count would be another text's."""
    return F.coalesce(text.cast("string"), F.lit(""))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(content(text).cast("binary"), 256))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Counts that are stored for a tokenizer; empty where no cache has been written yet. Only the tokenizer's own folder is read."""
    stored = spark.read.schema(CACHE_SCHEMA).option("basePath", cache)
    try:
        rows = stored.parquet(f"{cache}/tokenizer={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def looked_up(docs: DataFrame, cache: str, tokenizer_path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): doc_id, n_bytes, digest of each row; digest, n_tokens, cached of each distinct content.

    Digests are narrow and counted per task before they are shuffled. They meet the cache once; of the distinct contents
    that it lacks, the row of the least doc_id is fetched and encoded, and the counts are appended; if it lacks none, no text is
    read again or shuffled. A lost executor repeats only its tasks; the append is committed by Spark's writer. Two jobs that append at once may both store a digest, with the same count.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    small_batches(spark)

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(tokenizer_path)
        for batch in batches:
            n = [own.count(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    whole = docs.select("doc_id", content(F.col("text")).alias("text"))
    rows = stash(whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest(F.col("text")).alias("digest")))
    distinct = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    stored = read_cache(spark, cache, version).withColumnRenamed("digest", "__digest")
    found = stash(distinct.join(stored, F.col("digest") == F.col("__digest"), "left").select("digest", "first", "n_tokens"))
    hits = found.where("n_tokens IS NOT NULL").select("digest", "n_tokens", F.lit(True).alias("cached"))
    misses = found.where("n_tokens IS NULL").select(F.col("digest").alias("__digest"), F.col("first").alias("__first"))
    if misses.isEmpty():
        return rows, hits
    texts = whole.withColumn("digest", digest(F.col("text"))).join(misses, (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__first")), "left_semi")
    # repeated rows of the least id are encoded each, and counted once
    made = stash(texts.select("digest", "text").mapInArrow(counted, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    made.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    return rows, hits.unionByName(made.withColumn("cached", F.lit(False)))


def token_counts(docs: DataFrame, cache: str, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cached of every row of docs (doc_id, text), of whole texts.

    Counts are looked up by the digests of content and tokenizer in the cache, a folder of Parquet
    files that every executor reaches; missing ones are encoded and appended. cached: the count was there before. Null is the
    empty text: 0 bytes, 0 tokens. Copies are encoded once; a content with very many copies is no task's work. A very long text
    is encoded whole, by one task. An empty table gives an empty one; extra columns are ignored.
    """
    rows, counts = looked_up(docs, cache, tokenizer_path)
    counts = counts.withColumnRenamed("digest", "__digest")
    return join_hot(rows, ["digest"], counts, ["__digest"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills an empty cache of its own with the contents of documents, then counts documents through it: all counts come from the cache."""
    import public_tokenizers

    docs, cache, path = table(spark, sf_dir, "documents"), shared_dir(spark), public_tokenizers.path("byte_bpe_50k.json")
    looked_up(docs, cache, path)
    return token_counts(docs, cache, path)
