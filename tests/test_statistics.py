"""Statistics that merge in any order, and a cache that falls back where its folder cannot be written."""

import numpy as np
from pyspark.sql import functions as F

from stepwright.operators import stats
from stepwright.sources.storage import scratch


def rows(spark, n=4000):
    draw = np.random.default_rng(1)
    data = [(int(i % 7), [float(a), float(b), float(c)]) for i, (a, b, c) in enumerate(zip(draw.normal(size=n) * 10, draw.lognormal(0, 4, n), np.where(draw.random(n) < 0.3, 0, -draw.random(n))))]
    return data, spark.createDataFrame(data, "shard int, v array<double>")


def test_merging_in_any_order_is_the_whole_within_the_error(spark):
    data, df = rows(spark)
    shares = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    results = []
    for orders in ([0, 1, 2, 3, 4, 5, 6], [6, 2, 4, 0, 1, 3, 5]):
        folder = scratch(spark)
        for k in range(0, 7, 3):
            stats.update_statistics(df.where(F.col("shard").isin(orders[: k + 3])), "v", "shard", folder)
        results.append(sorted(stats.stored_statistics(spark, folder, shares).collect(), key=lambda r: r["dim"]))
    x = np.array([v for _, v in data])
    for one in results:
        for d, r in enumerate(one):
            assert (r["n"], r["min"], r["max"]) == (len(x), x[:, d].min(), x[:, d].max())
            assert np.isclose(r["mean"], x[:, d].mean()) and np.isclose(r["std"], x[:, d].std())
            exact = np.sort(x[:, d])[[int(np.floor(q * (len(x) - 1))) for q in shares]]
            assert np.all(np.abs(np.array(r["quantiles"]) - exact) <= stats.ERROR * np.abs(exact) + 1e-12)
    assert [r["quantiles"] for r in results[0]] == [r["quantiles"] for r in results[1]]


def test_shards_that_are_there_are_not_computed_again(spark):
    _, df = rows(spark, 70)
    folder = scratch(spark)
    stats.update_statistics(df.where("shard < 3"), "v", "shard", folder)
    poisoned = df.withColumn("v", F.when(F.col("shard") < 3, F.array(F.lit(1e9), F.lit(1e9), F.lit(1e9))).otherwise(F.col("v")))
    stats.update_statistics(poisoned, "v", "shard", folder)
    assert max(r["max"] for r in stats.stored_statistics(spark, folder, [0.5]).collect()) < 1e9


def test_cache_falls_back_where_the_folder_cannot_be_written(spark, tmp_path):
    steps = spark.createDataFrame([("a", 1, [1.0], [2.0]), ("a", 1, [3.0], [2.0])], "dataset_name string, episode_id long, action array<double>, proprio array<double>")
    (tmp_path / "file").write_text("no folder")
    broken, fallback = f"{tmp_path}/file", f"{tmp_path}/fallback"
    first = stats.cached_statistics(steps, broken, "a", {}, fallback=fallback)
    assert {r["mean"] for r in first.where("field = 'action'").collect()} == {2.0}
    changed = steps.withColumn("action", F.array(F.lit(9.0)))
    again = stats.cached_statistics(changed, broken, "a", {}, fallback=fallback)
    assert {r["mean"] for r in again.where("field = 'action'").collect()} == {2.0}
