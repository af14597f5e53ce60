"""Pieces shared by the corpus operators: intermediate tables, running totals, word hashing, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach.

    Only where the cluster names none (tests, local runs) a folder below the warehouse is used.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/stepwright-{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Arrow batches of whole texts have so many rows in what is written meanwhile; then the session is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_unit(text: Column) -> Column:
    """(0, 1] from the first 13 hex digits (52 bits) of an MD5, the same in any SQL engine."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores in front until no column has it (Spark's names know no case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_order(df: DataFrame, order: list[str], part: str = "__part", parts: int | None = None) -> DataFrame:
    """df range-sorted into parts by `order`, written, with the number of its part; parts are in ascending order.

    If `order` tells all rows apart, no part can be much larger than the others. Without `parts` Spark joins small ones.
    """
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return stash(ranged.withColumn(part, F.spark_partition_id()))


def running(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add `out`: the running sum of `value` within `group`, up to and with the row, in the given order.

    Rows are range-sorted into parts; each part's rows are summed by themselves and raised by the totals of the
    group's parts before, of which there is a row per part. No task holds a group.
    """
    kept = df.columns
    parted = in_order(df, [*group, *order])
    totals = parted.groupBy(*group, "__part").agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    right = totals.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(group)], F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    on = F.col("__part") == F.col("__p")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"__{i}"))
    inside = F.sum(value).over(Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parted.withColumn("__inside", inside).join(right, on).select(*kept, (F.col("__inside") + F.col("__before")).alias(out))


def join_hot(rows: DataFrame, keys: list[str], right: DataFrame, right_keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """rows joined to right, which has one row per key; keys with very many rows do not meet in one task.

    Hot keys have more than half a shuffle partition's rows (1000 at least), so there are at most two per partition: a
    bounded list, which is sent along with their rows of `right`. All others are shuffled. rows should be a written table,
    unless `counts` (keys, n_rows) tells how many rows each key has.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
        total = rows.count()
    else:
        total = counts.agg(F.sum("n_rows")).first()[0] or 0
    names = [f"__hot{i}" for i in range(len(keys))]
    hot = stash(counts.where(F.col("n_rows") > max(1000, total // (2 * parts))).select(*[F.col(k).alias(c) for k, c in zip(keys, names)]))

    def equal(a: list[str], b: list[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(p) == F.col(q) for p, q in zip(a, b)])

    if hot.isEmpty():
        return rows.join(right, equal(keys, right_keys))
    marked = rows.join(F.broadcast(hot), equal(keys, names), "left")
    their = F.broadcast(right.join(F.broadcast(hot), equal(right_keys, names), "left_semi"))
    few = marked.where(F.col(names[0]).isNull()).drop(*names).join(right, equal(keys, right_keys))
    many = marked.where(F.col(names[0]).isNotNull()).drop(*names).join(their, equal(keys, right_keys))
    return few.unionByName(many)


#: The bytes that separate words.
_SPLIT = re.compile(rb"[\x20\x09-\x0D]+")


def lower_words(data: bytes) -> list[bytes]:
    """Words of UTF-8 text with A-Z lower-cased. bytes.split() parts at exactly \\x20 and \\x09-\\x0D."""
    return data.lower().split()


class Numbering(dict):
    """word -> number in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self), np.uint64, len(self))


def texts_of(batch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a column of an Arrow batch; null is empty."""
    import pyarrow as pa

    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def checksum(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge table (a, b): component is the least node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Minima come from
    pre-aggregated groups and reach the edges of a node with very many neighbours as a bounded list, so such a node costs
    no single task; every round is a written table and only a row count and checksum reach the driver.
    """
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = checksum(edges)
    while seen[0]:
        both = stash(edges.select("a", "b").union(edges.select("b", "a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = stash(join_hot(both, ["a"], least, ["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        joined = join_hot(large, ["a"], least, ["n"])
        small = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = stash(small)
        now = checksum(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


@lru_cache(maxsize=8)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
