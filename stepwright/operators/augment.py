"""Perturbed actions and shuffled words, drawn by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import draw, hash_draw


def negative_actions(window: Column, key: Column, noise: float, pad: float = -5.0, seed: int = 0) -> Column:
    """Each motion dim of the non-pad rows moved up or down by `noise` (sign by key and dim), the gripper's sign flipped.

    A random number of leading dims, at least one, is moved; rows of padding stay.
    """
    def moved(a: Column) -> Column:
        n = F.size(a) - 1
        prefix = F.floor(draw(key, seed) * n) + 1
        step = lambda x, i: F.when(i == n, -x).when(i < prefix, x + F.when(F.pmod(key + i * 7, F.lit(2)) == 0, noise).otherwise(-noise)).otherwise(x)
        return F.transform(a, step)

    return F.transform(window, lambda a: F.when(F.forall(a, lambda x: x == pad), a).otherwise(moved(a)))


def gaussian_samples(actions: DataFrame, group: list[str], column: str, n: int, low: float = -1.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    """n draws per group from the mean and population deviation of each dim, clipped; the last dim is 1 where its mean is 0.5 or more.

    Normal variates come from two keyed uniforms (Box and Muller), so a rerun draws the same.
    """
    long = actions.select(*group, F.posexplode(column).alias("dim", "x"), (F.size(column) - 1).alias("__last"))
    stats = long.groupBy(*group, "dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max("__last").alias("__last"))
    samples = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))
    u = F.greatest(hash_draw(*group, "sample", "dim", seed=seed), F.lit(1e-12))
    v = hash_draw(*group, "sample", "dim", seed=seed + 1)
    normal = F.sqrt(F.log(u) * -2) * F.cos(v * 6.283185307179586)
    value = F.when(F.col("dim") == F.col("__last"), F.when(F.col("m") >= 0.5, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col("m") + F.col("s") * normal)))
    rows = samples.withColumn("v", value).groupBy(*group, "sample").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("a"))
    return rows.select(*group, "sample", F.transform("a", lambda r: r["v"]).alias(column))


def shuffled_words(text: Column, key: Column, seed: int = 0) -> Column:
    """Words in keyed order with a final mark kept at the end; where the order would not change it is turned round."""
    end = F.regexp_extract(text, r"([.?!]*)$", 1)
    words = F.split(F.trim(F.regexp_replace(text, r"[.?!]*$", "")), " ")
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("i"), w.alias("w"))))
    mixed = F.transform(placed, lambda r: r["w"])
    differs = F.when(mixed == words, F.reverse(words)).otherwise(mixed)
    return F.concat(F.array_join(differs, " "), end)
