"""Readers of record layouts: rephrase maps, chunked episodes with their metadata, tasks, rollouts by path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_rephrases(spark: SparkSession, path: str) -> DataFrame:
    """(id, original, pos, rephrase) of {id, original, rephrases[]} records; blank originals and rephrases are dropped."""
    rows = spark.read.schema("id string, original string, rephrases array<string>").json(path)
    good = rows.where(F.trim(F.coalesce("original", F.lit(""))) != "")
    return good.select("id", "original", F.posexplode(F.filter("rephrases", lambda x: F.trim(x) != "")).alias("pos", "rephrase"))


def rephrases_of_map(spark: SparkSession, path: str) -> DataFrame:
    """The same for one file that holds {id: {original, rephrases[]}}: read as text once, parsed as a map."""
    text = spark.read.text(path, wholetext=True)
    entry = "map<string, struct<original: string, rephrases: array<string>>>"
    rows = text.select(F.explode(F.from_json("value", entry)).alias("id", "e")).select("id", "e.*")
    return rows.where(F.trim("original") != "").select("id", "original", F.posexplode(F.filter("rephrases", lambda x: F.trim(x) != "")).alias("pos", "rephrase"))


def chunk_filter(spec: str | None) -> list[int] | None:
    """ "0,1" to [0, 1]; None or blank is no filter."""
    parts = [x.strip() for x in (spec or "").split(",") if x.strip()]
    return [int(x) for x in parts] or None


def episode_frames(episodes: DataFrame, data: DataFrame, chunks: Sequence[int] | None = None) -> DataFrame:
    """Rows of each episode: those of its data file whose index is in [dataset_from_index, dataset_to_index).

    episodes: episode_index, chunk_index, file_index, dataset_from_index, dataset_to_index; data: chunk_index,
    file_index, index, ... A chunk filter on the partition column is left to partition pruning.

    Slices meet rows by equality: a slice of more than 64**k and at most 64**(k + 1) indices lies in two bins of that width at
    most, and a row is looked for in its bin of each width that some slice has. So a row is compared with at most 65 slices a
    width where slices do not overlap, however many episodes a file holds.
    """
    if chunks is not None:
        episodes, data = episodes.where(F.col("chunk_index").isin(*chunks)), data.where(F.col("chunk_index").isin(*chunks))
    slices = episodes.where("dataset_from_index < dataset_to_index").select("episode_index", F.col("chunk_index").alias("__c"), F.col("file_index").alias("__f"), "dataset_from_index", "dataset_to_index")
    level = F.floor((F.length(F.bin(F.col("dataset_to_index") - F.col("dataset_from_index") - 1)) - 1) / 6)  # digits in base 64, less one
    slices = slices.withColumn("__w", F.least(level, F.lit(9)).cast("int"))
    binned = lambda index: F.call_function("shiftright", F.col(index).cast("long") if isinstance(index, str) else index, (F.col("__w") + 1) * 6)
    e = slices.withColumn("__b", F.explode(F.sequence(binned("dataset_from_index"), binned(F.col("dataset_to_index").cast("long") - 1)))).withColumnRenamed("__w", "__v")
    widths = slices.agg(F.collect_set("__w").alias("__ws"))  # one row of ten numbers at most
    rows = data.crossJoin(F.broadcast(widths)).withColumn("__w", F.explode("__ws")).drop("__ws").withColumn("__bin", binned("index"))
    on = (F.col("chunk_index") == F.col("__c")) & (F.col("file_index") == F.col("__f")) & (F.col("__w") == F.col("__v")) & (F.col("__bin") == F.col("__b"))
    inside = (F.col("index") >= F.col("dataset_from_index")) & (F.col("index") < F.col("dataset_to_index"))
    return rows.join(e, on & inside).drop("__c", "__f", "__w", "__v", "__b", "__bin", "dataset_from_index", "dataset_to_index")


def prompt_from_task(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Add `prompt` from task_index; an index that the task table lacks is an error when the row is read."""
    joined = rows.join(tasks.select("task_index", F.col("task").alias("prompt")), "task_index", "left")
    return joined.withColumn("prompt", F.coalesce("prompt", F.raise_error(F.concat(F.lit("no task "), F.col("task_index").cast("string")))))


def rollout_fields(path: Column) -> dict[str, Column]:
    """What the file name of a rollout says: episode, success, task."""
    return {
        "episode": F.regexp_extract(path, r"episode=(\d+)", 1).cast("long"),
        "success": F.regexp_extract(path, r"success=(True|False)", 1) == "True",
        "task": F.regexp_extract(path, r"task=([^/]*?)(?:\.[a-z0-9]+)?$", 1),
    }


def trial_outcome(path: Column) -> Column:
    """1 for a path that holds 'success', 0 for 'failure', else null."""
    return F.when(F.instr(path, "success") > 0, 1).when(F.instr(path, "failure") > 0, 0)


def scan_rollouts(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON records of rollouts with the fields of their file names."""
    rows = spark.read.schema(schema).json(glob).withColumn("path", F.input_file_name())
    return rows.withColumns(rollout_fields(F.col("path")))
