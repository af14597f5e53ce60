"""The verifier dataset: windows and instructions as dimensions, samples as facts, and their rephrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import draw
from ..functions.text import key_a
from ..sources.storage import scratch, written


def window_id(column: str) -> Column:
    """Stable 128-bit id of a window's content: two XXH64 hashes in hex. They take -0.0 for 0.0."""
    return F.concat(F.hex(F.xxhash64(column)), F.lit("-"), F.hex(F.xxhash64(F.lit(7), F.col(column))))


def normal_form(steps: DataFrame, window: str = "action_window", pad: float = -5.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, action_histories, instructions) of windowed steps.

    Steps without an instruction and windows of padding alone give no sample. Windows meet on a digest of 32
    characters; the arrays themselves are taken along only once per distinct window and task.
    """
    named = steps.withColumns({"instruction": key_a(F.col("language_instruction")), "action_history_id": window_id(window)})
    kept = named.where(F.col("instruction").isNotNull() & F.exists(window, lambda a: F.exists(a, lambda x: x != pad)))
    samples = kept.select("action_history_id", F.md5(F.col("instruction").cast("binary")).alias("instruction_id"), "episode_id", "t", *[c for c in ("image_file",) if c in kept.columns])
    histories = kept.groupBy("action_history_id").agg(F.first(window).alias("action_window"))
    instructions = kept.select(F.md5(F.col("instruction").cast("binary")).alias("instruction_id"), F.col("instruction").alias("text")).distinct()
    return samples, histories, instructions


def normal_form_metadata(samples: DataFrame) -> DataFrame:
    """One row of counts: samples, distinct windows and instructions, how often a window is used, samples per instruction.

    Samples are first counted by (instruction, window); both kinds of totals come from those counts.
    """
    pairs = samples.groupBy("instruction_id", "action_history_id").agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy("instruction_id").agg(F.sum("n").alias("n"))
    spread = per.agg(
        F.sum("n").alias("total_samples"), F.min("n").alias("min_per_instruction"), F.avg("n").alias("mean_per_instruction"), F.max("n").alias("max_per_instruction"), F.count(F.lit(1)).alias("unique_instructions")
    )
    windows = pairs.select("action_history_id").distinct().agg(F.count(F.lit(1)).alias("unique_action_histories"))
    return spread.join(F.broadcast(windows)).withColumn("reuse_ratio", F.col("total_samples") / F.col("unique_action_histories"))  # one row each


def write_normal_form(samples: DataFrame, histories: DataFrame, instructions: DataFrame, path: str) -> None:
    """Three tables and their counts."""
    spark = samples.sparkSession
    for name, df in (("samples", samples), ("action_histories", histories), ("instructions", instructions)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    normal_form_metadata(spark.read.parquet(f"{path}/samples")).coalesce(1).write.mode("overwrite").json(f"{path}/_metadata_json")


def numbered_by_first(df: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """value -> its place in order of first sight, for readers that expect small numbers; one row per distinct value.

    Distinct values are range-sorted; each part is numbered by itself and raised by the sizes of the parts before it.
    """
    first = df.groupBy(value).agg(F.min(F.struct(*order, value)).alias("__first"))
    parted = written(first.repartitionByRange("__first").withColumn("__part", F.spark_partition_id()), scratch(df.sparkSession))
    sizes = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row per part
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = parted.withColumn("__inside", F.row_number().over(Window.partitionBy("__part").orderBy("__first")))
    return inside.join(sizes.select("__part", before.alias("__before")), "__part").select(value, (F.col("__before") + F.col("__inside") - 1).alias(out))


def rephrase_fanout(samples: DataFrame, rephrases: DataFrame) -> DataFrame:
    """Samples and, for each rephrase of their instruction, a copy with the rephrase; window and image are reused.

    samples: instruction, ...; rephrases: original, pos, rephrase. One pass: rephrases of rephrases are not followed.
    """
    original = samples.withColumns({"text": F.col("instruction"), "pos": F.lit(0)})
    copies = samples.join(rephrases.select(F.col("original").alias("instruction"), F.col("rephrase").alias("text"), "pos"), "instruction")
    return original.unionByName(copies.select(original.columns))


def new_instruction_keys(rephrases: DataFrame) -> DataFrame:
    """(rephrase, original) for rephrases that are not an original themselves; of equal rephrases the first original's."""
    fresh = rephrases.join(rephrases.select(F.col("original").alias("rephrase")).distinct(), "rephrase", "left_anti")
    return fresh.groupBy("rephrase").agg(F.min(F.struct("original", "pos")).alias("f")).select("rephrase", F.col("f.original").alias("original"))


def dedup_rephrases(rephrases: DataFrame, least: int = 10) -> DataFrame:
    """Rephrases of `least` characters or more, unlike their original and, without case and outer blanks, unlike an earlier one of it."""
    same = F.lower(F.trim("rephrase"))
    good = rephrases.where((F.length(F.trim("rephrase")) >= least) & (same != F.lower(F.trim("original"))))
    first = F.row_number().over(Window.partitionBy("original", same).orderBy("pos", "rephrase"))
    return good.withColumn("__n", first).where("__n = 1").drop("__n")


def merged_rephrases(files: DataFrame) -> DataFrame:
    """Several files' rephrases per suite without duplicates, at the place of their first sight.

    files: file, suite, original, pos, rephrase.
    """
    first = files.where(F.trim("rephrase") != "").groupBy("suite", "original", "rephrase").agg(F.min(F.struct("file", "pos")).alias("f"))
    place = F.row_number().over(Window.partitionBy("suite", "original").orderBy("f", "rephrase"))
    return first.select("suite", "original", "rephrase", (place - 1).alias("pos"))


def prepended_alternates(rephrases: DataFrame, alternates: DataFrame, key) -> DataFrame:
    """Rephrase lists with alternates in front that are not in them after normalization by `key`.

    rephrases: original, pos, rephrase; alternates: original, pos, rephrase (of any source).
    """
    named = rephrases.withColumn("__k", key(F.col("rephrase")))
    fresh = alternates.withColumn("__k", key(F.col("rephrase"))).where("__k <> ''").join(named.select("original", "__k"), ["original", "__k"], "left_anti")
    fresh = fresh.withColumn("__n", F.row_number().over(Window.partitionBy("original", "__k").orderBy("pos", "rephrase"))).where("__n = 1").drop("__n")
    both = fresh.withColumn("__old", F.lit(0)).unionByName(named.withColumn("__old", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("original").orderBy("__old", "pos", "rephrase"))
    return both.select("original", "rephrase", (place - 1).alias("pos"))


def trim_rephrases(samples: DataFrame, instructions: DataFrame, k: int, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first 1 + k variants of each sample group, and the instructions that are still used."""
    kept = samples.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= k + 1).drop("__n")
    return kept, instructions.join(kept.select("instruction_id"), "instruction_id", "left_semi")


def picked_variant(df: DataFrame, variants: str, most: int, key: Column, seed: int = 0) -> DataFrame:
    """One of the first `most` variants, by the key."""
    capped = F.slice(variants, 1, most)
    return df.withColumn("variant", F.get(capped, F.floor(draw(key, seed) * F.size(capped)).cast("int")))


def alternate_sets(df: DataFrame, key: Column, text: str) -> DataFrame:
    """Sorted distinct texts per normalized key."""
    return df.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.sort_array(F.collect_set(text)).alias("alternates"))


def orphans(dimension: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Rows of a dimension that no sample uses."""
    return dimension.join(samples.select(key), key, "left_anti")
