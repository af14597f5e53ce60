"""Order of mixtures, bounded shuffles, negatives without loss, ranks by parts, percentiles of crowded tables."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwright.functions.keyed import numbered
from stepwright.operators import metrics, mixture, retrieval, stats


def test_negatives_are_complete_though_one_content_has_most_rows(spark):
    rows = spark.range(2000).select(F.col("id").alias("key"), F.when(F.col("id") < 1800, 0).otherwise(F.col("id")).alias("content"))
    got = retrieval.negative_pool(rows, rows, "key", "content", 5).collect()
    per = collections.Counter(r["key"] for r in got)
    assert len(got) == len(set(got)) == 10_000 and set(per.values()) == {5} and len(per) == 2000
    content = lambda k: 0 if k < 1800 else k
    assert all(content(r["key"]) != content(r["negative"]) for r in got)
    drawn = collections.Counter(r["negative"] for r in got if r["key"] < 1800)
    assert len(drawn) == 200 and max(drawn.values()) < 3 * 1800 * 5 / 200


def test_negatives_of_small_pools_and_unknown_contents(spark):
    pool = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "key long, content string")
    asks = spark.createDataFrame([(1, "a"), (3, "b"), (4, None), (9, "z")], "key long, content string")
    got = collections.defaultdict(set)
    for r in retrieval.negative_pool(asks, pool, "key", "content", 3).collect():
        got[r["key"]].add(r["negative"])
    assert got[1] == {3, 4} and got[3] == {1, 2, 4} and got[4] == {1, 2, 3} and len(got[9]) == 3
    assert retrieval.negative_pool(asks, pool.limit(0), "key", "content", 3).collect() == []


def test_buffer_moves_no_row_further_than_its_size(spark):
    rows = spark.range(5000).withColumn("position", F.col("id"))
    for buffer in (100, 33, 2):
        moved = mixture.buffer_shuffled(rows, "position", buffer, 3).collect()
        assert sorted(r["position"] for r in moved) == list(range(5000))
        far = [abs(r["position"] - r["id"]) for r in moved]
        assert max(far) < buffer
        assert buffer == 2 or sum(far) / 5000 > buffer / 8
    crossed = [r for r in mixture.buffer_shuffled(rows, "position", 100, 3).collect() if r["id"] // 50 != r["position"] // 50]
    assert len(crossed) > 1000  # blocks mix


def test_interleaved_order_has_its_shares_in_prefixes_and_whole_epochs(spark):
    rows = spark.range(1300).select(F.when(F.col("id") < 1000, "big").when(F.col("id") < 1290, "mid").otherwise("tiny").alias("dataset_name"), F.col("id").alias("row"))
    out = sorted(mixture.interleaved(rows, [("big", 5.0), ("mid", 3.0), ("tiny", 2.0), ("none", 9.0)], 3000, F.col("row"), ["row"], 1, block=128).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in out] == list(range(3000))
    for prefix in (600, 1500, 3000):
        n = collections.Counter(r["dataset_name"] for r in out[:prefix])
        assert abs(n["big"] - 0.5 * prefix) < 0.06 * prefix and abs(n["tiny"] - 0.2 * prefix) < 0.06 * prefix
    for name, size in (("big", 1000), ("mid", 290), ("tiny", 10)):
        taken = [(r["epoch"], r["row"]) for r in out if r["dataset_name"] == name]
        assert [e for e, _ in taken] == [k // size for k in range(len(taken))]
        assert all(len({x for e, x in taken if e == epoch}) == size for epoch in range(len(taken) // size))
    again = mixture.interleaved(rows.repartition(7), [("big", 5.0), ("mid", 3.0), ("tiny", 2.0)], 3000, F.col("row"), ["row"], 1).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    with pytest.raises(ValueError, match="no dataset"):
        mixture.interleaved(rows, [("none", 1.0)], 10, F.col("row"), ["row"])


def test_numbers_are_dense_whatever_the_keys_spread(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2900, 0.0).otherwise(F.col("id") * 1e9).alias("u"), "id")
    got = sorted((r["number"], r["id"]) for r in numbered(rows, ["u", "id"]).collect())
    assert got == [(i, i) for i in range(3000)]
    assert numbered(rows.limit(0), ["u", "id"]).collect() == []


def test_longest_batch_goes_first_and_replicas_share_evenly(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3 == 0).alias("image"), F.when(F.col("id") == 41, 9999).otherwise(F.col("id") % 17).alias("length"))
    out = mixture.length_batches(rows, "image", "length", F.col("id"), ["id"], 8, 2).collect()
    assert {r["id"] for r in out if r["turn"] == 0} >= {41}
    assert len({(r["image"], r["batch"]) for r in out}) == len({r["turn"] for r in out}) == max(r["turn"] for r in out) + 1
    with pytest.raises(ValueError, match="evenly"):
        mixture.length_batches(rows, "image", "length", F.col("id"), ["id"], 8, 3)


def test_percentiles_of_groups_with_outliers_and_nulls(spark):
    rows = [("a", float(i), None) for i in range(101)] + [("a", 1e12, None), ("b", 7.0, 1.0), ("b", None, 3.0)]
    frame = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r["g"], r["name"], r["share"]): r["value"] for r in stats.percentiles(frame, ["x", "y"], [0.5, 0.99], ["g"]).collect()}
    assert got["a", "x", 0.5] == 50.5 and np.isclose(got["a", "x", 0.99], np.percentile([*range(101), 1e12], 99))
    assert got["b", "x", 0.5] == 7.0 and got["b", "y", 0.5] == 2.0 and ("a", "y", 0.5) not in got
    assert metrics.score_percentiles(frame, "x", [0.25]).first()["value"] == np.percentile([*range(101), 1e12, 7.0], 25)
