"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hex_unit, running, table


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree, with the path that leads to it."""

    region: int
    rack: int
    number: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Shard]:
    """shards equal leaves, per_rack to a rack and racks to a region."""
    return [Shard(i // (per_rack * racks), i // per_rack % racks, i) for i in range(shards)]


def grown(leaves: list[Shard], weight: float = 1.0, region: int | None = None, rack: int = 0) -> list[Shard]:
    """One more shard: in a region of its own by default, else in the given rack.

    In a region of its own no weight below any other region changes, so rows move only into the new shard. In a rack that is
    there, the rack's and the region's weights rise: rows come into the region from all others, and within it into the
    rack and the shard; no row moves between two other regions, or between two other racks of the region.
    """
    home = max((x.region for x in leaves), default=-1) + 1 if region is None else region
    return [*leaves, Shard(home, rack, max((x.number for x in leaves), default=-1) + 1, weight)]


def least_draw(key: Column, level: str, children: dict[int, float]) -> Column:
    """The child with the least -ln(u) / weight, u a hash of the key and the child; the lower child if equal."""
    draws = [F.struct((-F.log(hex_unit(F.concat(key, F.lit(f"|{level}{c}")))) / F.lit(float(w))).alias("d"), F.lit(c).alias("c")) for c, w in sorted(children.items()) if w > 0]
    return draws[0]["c"] if len(draws) == 1 else F.least(*draws)["c"]


def with_shard(df: DataFrame, key: Column, leaves: list[Shard], out: str) -> DataFrame:
    """Add `out`, the shard of a key: a weighted hash draw among the regions, then among the region's racks, then among the rack's shards.

    A node's weight is the sum below it and its draw hangs on its own path alone, so a changed weight
    moves keys only into or out of the subtrees that hold the change.
    """
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for x in leaves:
        regions.setdefault(x.region, {}).setdefault(x.rack, {})[x.number] = x.weight

    def chosen(col: Column, choices: dict[int, Column]) -> Column:
        picked = F.lit(None).cast("int")
        for value, column in sorted(choices.items()):
            picked = F.when(col == value, column).otherwise(picked)
        return picked

    kept = df.columns
    region = least_draw(key, "g", {r: sum(sum(s.values()) for s in racks.values()) for r, racks in regions.items()})
    at_region = df.select(*kept, region.alias("__region"))
    rack = chosen(F.col("__region"), {r: least_draw(key, f"g{r}k", {k: sum(s.values()) for k, s in racks.items()}) for r, racks in regions.items()})
    at_rack = at_region.select("*", rack.alias("__rack"))
    node = F.col("__region") * 100_000 + F.col("__rack")
    leaf = chosen(node, {r * 100_000 + k: least_draw(key, f"g{r}k{k}s", s) for r, racks in regions.items() for k, s in racks.items()})
    return at_rack.select(*kept, leaf.cast("int").alias(out))


def shard(docs: DataFrame, leaves: list[Shard]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for docs (doc_id, text); one row per input row.

    doc_id and the tree alone decide (law `key`); grown_shard is the shard once the tree has one more.
    size is the UTF-8 bytes of the text plus 1. Null text has size 1 and the crc32 of the empty text; null
    doc_ids share one shard. slot numbers a shard's rows from 0 without gaps, in hash order; rows of one id stand next to each
    other, equal rows in no order of their own. Very long texts are read where they are: only narrow columns are
    shuffled. An empty table gives an empty one; extra columns are ignored, whatever their names.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    keyed = narrow.withColumn("__key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    placed = with_shard(with_shard(keyed, F.col("__key"), leaves, "shard"), F.col("__key"), grown(leaves), "grown_shard")
    hashed = placed.withColumn("__hash", F.md5(F.col("__key").cast("binary"))).withColumn("__one", F.lit(1)).withColumn("__row", F.monotonically_increasing_id())
    numbered = running(hashed, ["shard"], ["__hash", "doc_id", "text_crc32", "size", "__row"], "__one", "__n")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__n") - 1).cast("long").alias("slot"), "grown_shard")


def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), tree(16))
