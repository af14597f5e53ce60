"""Data sources: both layouts of chunked episodes with filters that prune, embedding shards that resume, and shards that are malformed."""

import collections
import os

import pytest
from pyspark.sql import functions as F

from stepwright.sources import formats
from stepwright.sources.storage import scratch


@pytest.fixture(scope="module")
def frames(spark):
    formats.register(spark)
    episodes = spark.range(40).select(F.col("id").alias("episode_index"), F.explode(F.sequence(F.lit(0), F.col("id") % 7)).alias("frame_index"))
    placed = episodes.withColumns({"chunk_index": F.floor(F.col("episode_index") / 10).cast("int"), "file_index": (F.col("episode_index") % 10 >= 5).cast("int")})
    return placed.withColumn("index", F.col("episode_index") * 10 + F.col("frame_index")).withColumn("action", F.array(F.col("index").cast("double"))).cache()


def local(folder):
    return folder.removeprefix("file:")


@pytest.mark.parametrize("layout", ["files", "jsonl"])
def test_episodes_come_back_and_filters_prune(spark, frames, layout):
    folder = scratch(spark)
    formats.write_episodes(frames.repartition(6), folder, layout, 10)
    read = lambda **options: spark.read.format("lerobot").options(**options).load(folder)
    rows = lambda df: sorted((r["episode_index"], r["chunk_index"], r["index"], r["action"][0]) for r in df.select("episode_index", "chunk_index", "index", "action").collect())
    assert rows(read()) == rows(frames)
    assert rows(read(chunks="1, 3")) == rows(frames.where("chunk_index IN (1, 3)"))
    # what is not asked for is not opened: break all files of the other chunks
    for chunk in (0, 2):
        for top in ("data", "meta/episodes"):
            path = f"{local(folder)}/{top}/chunk-{chunk:03d}"
            for name in os.listdir(path) if os.path.isdir(path) else []:
                with open(f"{path}/{name}", "wb") as f:
                    f.write(b"broken")
    spark.conf.set(formats.PUSHDOWN, "true")
    try:
        schema = "episode_index long, chunk_index int, index long, action array<double>"
        given = spark.read.format("lerobot").schema(schema).option("filters", "true").load(folder)
        assert rows(given.where("chunk_index IN (1, 3) AND episode_index IN (12, 39, 3)")) == rows(frames.where("episode_index IN (12, 39)"))
        assert rows(given.where("chunk_index = 1 AND index % 2 = 0")) == rows(frames.where("chunk_index = 1 AND index % 2 = 0"))
    finally:
        spark.conf.unset(formats.PUSHDOWN)
    assert rows(read(chunks="1")) == rows(frames.where("chunk_index = 1"))
    with pytest.raises(Exception, match="magic|Parquet|Invalid"):
        rows(spark.read.format("lerobot").schema(schema).option("chunks", "0").load(folder))


def test_missing_data_files_of_the_list_are_left_out(spark, frames):
    folder = scratch(spark)
    formats.write_episodes(frames, folder, "jsonl", 10)
    os.remove(f"{local(folder)}/data/chunk-001/episode_000012.parquet")
    rows = spark.read.format("lerobot").load(folder)
    assert {r[0] for r in rows.select("episode_index").distinct().collect()} == set(range(40)) - {12}


def shards(spark):
    return spark.range(100).select("id", (F.col("id") % 5).cast("int").alias("shard"), F.when(F.col("id") == 7, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("v"))


def test_a_run_that_breaks_off_is_resumed_and_no_shard_is_there_twice(spark):
    formats.register(spark)
    folder, rows = scratch(spark), shards(spark)
    breaks = rows.withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        formats.write_missing_shards(breaks, folder, 5)
    assert formats.finished(folder) == {}  # no commit, whatever tasks have written
    formats.write_missing_shards(rows.where("shard IN (0, 2)"), folder, 5)
    files = {s: x["file"] for s, x in formats.finished(folder).items()}
    assert set(files) == {0, 2}
    for _ in range(2):
        formats.write_missing_shards(rows, folder, 5)
    after = {s: x["file"] for s, x in formats.finished(folder).items()}
    assert set(after) == set(range(5)) and {s: after[s] for s in files} == files
    read = spark.read.format("embedding_shards").load(folder)
    assert sorted(r["id"] for r in read.collect()) == list(range(100))
    good = spark.read.format("embedding_shards").option("vector", "v").option("dim", 2).load(folder)
    assert sorted(r["id"] for r in good.select("id").collect()) == [i for i in range(100) if i != 7]


def test_malformed_and_missing_shards_are_listed(spark):
    formats.register(spark)
    folder = scratch(spark)
    formats.write_missing_shards(shards(spark).where("shard <> 4"), folder, 5)
    files = {s: x["file"] for s, x in formats.finished(folder).items()}
    with open(f"{local(folder)}/{files[1]}", "wb") as f:
        f.write(b"broken")
    with open(f"{local(folder)}/{formats.MANIFEST}/00003.json") as f:
        told = f.read()
    with open(f"{local(folder)}/{formats.MANIFEST}/00003.json", "w") as f:
        f.write(told.replace('"rows": 20', '"rows": 21'))
    listed = spark.read.format("embedding_shards").option("problems", "true").option("shards", 5).option("vector", "v").option("dim", 2).load(folder).collect()
    assert {r["shard"]: r["problem"].split(":")[0] for r in listed} == {1: "unreadable", 2: "1 malformed rows", 3: "20 rows of 21", 4: "missing"}
    left = collections.Counter(r["shard"] for r in spark.read.format("embedding_shards").load(folder).collect())
    assert left == {0: 20, 2: 20}


def test_rows_of_a_shard_in_two_tasks_are_an_error(spark):
    formats.register(spark)
    rows = shards(spark).repartition(3).sortWithinPartitions("shard")
    with pytest.raises(Exception, match="two tasks"):
        rows.write.format("embedding_shards").option("shards", 5).mode("append").save(scratch(spark))
