"""Dataset statistics per dimension, exact and by histogram, and their files."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import scratch, written


def dims(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, field, dim, x) rows of vector columns."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.transform(c, lambda x: x.cast("double")).alias("v")) for c in columns])).alias("f")
    return df.select(*keys, fields).select(*keys, "f.field", F.posexplode("f.v").alias("dim", "x"))


def exact_percentiles(long: DataFrame, spans: DataFrame, keys: Sequence[str], shares: Sequence[float], bins: int = 4096, crowded: int = 1_000_000) -> DataFrame:
    """(keys, share, value): exact percentiles with linear interpolation, without gathering a group's values in one task.

    long: keys, x; spans: keys, lo, hi, n (one row per group, a written table). While a span has more than `crowded` rows, its
    values are counted in equal bins, and the bin that holds an asked rank becomes the next span; then the values of the spans
    are counted and ordered. An outlier that crowds a group into one bin costs one more pass, no large task. What is joined to
    all rows is a row per group, share and neighbour rank: dims of a mixture's datasets, sent along only if Spark finds it small.
    """
    k = list(keys)
    spark = long.sparkSession
    crowds = (F.col("lo") < F.col("hi")) & (F.col("c") > crowded)
    rank = F.col("share") * (F.col("n") - 1)
    asked = spans.select(*k, "lo", "hi", "n", F.col("n").alias("c"), F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("share"))
    places = F.explode(F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))).alias("i")
    wanted = asked.select(*k, "share", (rank - F.floor(rank)).alias("part"), places, F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), F.lit(0).cast("long").alias("below"), "c")

    def inside(rows: DataFrame) -> DataFrame:
        return long.select(*k, "x").join(rows.select(*k, "lo", "hi").distinct(), k).where(F.col("x").between(F.col("lo"), F.col("hi")))

    while not wanted.where(crowds).isEmpty():
        now = wanted.drop("c")
        width = (F.col("hi") - F.col("lo")) / bins
        place = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
        counts = inside(now).groupBy(*k, "lo", "hi", place.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
        before = F.sum("c").over(Window.partitionBy(*k, "lo", "hi").orderBy("bin")) - F.col("c")
        found = counts.withColumn("before", before).join(now, [*k, "lo", "hi"])
        found = found.where((F.col("i") >= F.col("below") + F.col("before")) & (F.col("i") < F.col("below") + F.col("before") + F.col("c")))
        wanted = written(found.select(*k, "share", "part", "i", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("before")).alias("below"), "c"), scratch(spark))
    values = inside(wanted).groupBy(*k, "lo", "hi", "x").agg(F.count(F.lit(1)).alias("m"))
    ordered = values.withColumn("upto", F.sum("m").over(Window.partitionBy(*k, "lo", "hi").orderBy("x")))
    hit = ordered.join(wanted, [*k, "lo", "hi"]).where((F.col("i") >= F.col("below") + F.col("upto") - F.col("m")) & (F.col("i") < F.col("below") + F.col("upto")))
    pairs = hit.groupBy(*k, "share", "part").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return pairs.select(*k, "share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


def percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, name, share, value): exact percentiles of columns, per group or of all rows, nulls left out; no task gathers a group's values.

    Keys are compared as they are, so groups whose key is null are left out.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")
    long = written(df.select(*by, each).select(*by, "v.*").where("x IS NOT NULL"), scratch(df.sparkSession))
    spans = long.groupBy(*by, "name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    return exact_percentiles(long, written(spans, scratch(df.sparkSession)), [*by, "name"], shares)


def dataset_statistics(steps: DataFrame, columns: Sequence[str] = ("action", "proprio")) -> DataFrame:
    """mean, population std, min, max, exact linear q01 and q99 per dataset, field and dim, with step and episode counts.

    Everything is pre-aggregated before it is shuffled; quantiles come from counts per bin, so that a giant dataset's values
    never meet in one task.
    """
    keys = ["dataset_name", "field", "dim"]
    long = dims(steps, columns, ["dataset_name"])
    per_dim = long.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count("x").alias("n"))
    per_dim = written(per_dim, scratch(steps.sparkSession))
    spans = per_dim.select(*keys, F.col("min").alias("lo"), F.col("max").alias("hi"), "n")
    q = exact_percentiles(long, spans, keys, (0.01, 0.99)).groupBy(*keys).agg(F.max(F.when(F.col("share") < 0.5, F.col("value"))).alias("q01"), F.max(F.when(F.col("share") > 0.5, F.col("value"))).alias("q99"))
    episodes = steps.groupBy("dataset_name", "episode_id").agg(F.count(F.lit(1)).alias("__n"))
    sizes = episodes.groupBy("dataset_name").agg(F.sum("__n").alias("num_transitions"), F.count(F.lit(1)).alias("num_trajectories"))
    return per_dim.drop("n").join(q, keys).join(sizes, "dataset_name")


def statistics_arrays(stats: DataFrame, field: str, names: Sequence[str] = ("mean", "std", "min", "max", "q01", "q99")) -> DataFrame:
    """One row per dataset with an array per statistic, in order of dim."""
    rows = stats.where(F.col("field") == field).groupBy("dataset_name").agg(F.sort_array(F.collect_list(F.struct("dim", *names))).alias("s"))
    return rows.select("dataset_name", *[F.col("s").getField(n).alias(n) for n in names])


def running_statistics(df: DataFrame, column: str) -> DataFrame:
    """Per dim the mean and the root of mean square less squared mean, never below zero; empty for fewer than two rows."""
    long = dims(df, [column])
    out = long.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("square"))
    return out.where("n >= 2").select("dim", "n", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))).alias("std"))


def histogram_quantiles(df: DataFrame, column: str, quantiles: Sequence[float], bins: int = 5000) -> DataFrame:
    """Left edges of the bins in which the quantiles fall, over `bins` equal bins from the least to the greatest value.

    Two passes, both pre-aggregated: the range of each dim, then a count per bin (bins rows per dim at most). Ranges are sent to
    the values, a row for each dim, so that a dim's values never meet in one task.
    """
    long = dims(df, [column])
    spans = long.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = long.join(F.broadcast(spans), "dim").withColumn("bin", F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))))
    counts = placed.groupBy("dim", "bin").agg(F.count(F.lit(1)).alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("n"))
    summed = counts.withColumn("through", F.sum("c").over(Window.partitionBy("dim").orderBy("bin")))
    asked = summed.select("*", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")).where(F.col("through") >= F.col("q") * F.col("n"))
    return asked.groupBy("dim", "q").agg(F.min("bin").alias("bin"), F.first("lo").alias("lo"), F.first("hi").alias("hi")).select("dim", "q", (F.col("lo") + F.col("bin") * width).alias("value"))


def save_statistics(stats: DataFrame, path: str) -> None:
    """Rows of statistics as JSON lines; the writer commits them whole or not at all."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def load_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The saved rows; a missing path is an error."""
    return spark.read.json(path)


def statistics_key(dataset: str, settings: dict) -> str:
    """Name under which statistics are cached: SHA-256 of the dataset and the settings they hang on."""
    import hashlib

    return hashlib.sha256((dataset + json.dumps(settings, sort_keys=True)).encode()).hexdigest()


def _loaded(spark: SparkSession, path: str) -> DataFrame | None:
    """Saved rows, or None where none have been committed."""
    try:
        return load_statistics(spark, path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    return None


def cached_statistics(steps: DataFrame, folder: str, dataset: str, settings: dict, columns: Sequence[str] = ("action", "proprio"), fallback: str | None = None) -> DataFrame:
    """Statistics from the cache folder; computed and written there on first use. Only a missing entry leads to computing.

    Where the folder cannot be written they go to the fallback folder, if one is given, and are found there from then on.
    """
    spark, name = steps.sparkSession, f"dataset_statistics_{statistics_key(dataset, settings)}"
    places = [f"{x}/{name}" for x in (folder, fallback) if x]
    for path in places:
        if (rows := _loaded(spark, path)) is not None:
            return rows
    made = written(dataset_statistics(steps, columns), scratch(spark))
    for path in places:
        try:
            save_statistics(made, path)
            return load_statistics(spark, path)
        except Exception:
            if path == places[-1]:
                raise
    raise AssertionError("unreachable")


# ---------------------------------------------------------------- statistics that merge
ERROR = 0.001  # of a quantile, relative to its value


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def partial_statistics(df: DataFrame, column: str, shard: str, error: float = ERROR) -> tuple[DataFrame, DataFrame]:
    """(moments, buckets) of each shard and dim of a vector column, which add up in any order.

    moments: shard, dim, n, mean, m2 (squared deviations), min, max. buckets: shard, dim, sign, bucket, c: how many values are in
    (gamma ** (bucket - 1), gamma ** bucket] by size, zeros in bucket 0 of sign 0. Buckets do not hang on the range of the values, so
    nothing is binned anew when shards come; a dim has as many as its values' orders of magnitude need.
    """
    long = dims(df, [column], [shard])
    moments = long.groupBy(shard, "dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"), F.min("x").alias("min"), F.max("x").alias("max"))
    sign = F.signum("x").cast("int")
    bucket = F.when(F.col("x") == 0, 0).otherwise(F.ceil(F.log(F.abs("x")) / math.log(_gamma(error)))).cast("int")
    return moments, long.where("x IS NOT NULL").groupBy(shard, "dim", sign.alias("sign"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))


def update_statistics(df: DataFrame, column: str, shard: str, folder: str, error: float = ERROR) -> None:
    """Add the shards that the folder does not have yet; the rows of others are not read again if `shard` is a partition column.

    Each shard's folders are replaced as a whole, the moments last, so a run that breaks off is mended by the next.
    """
    spark, new = df.sparkSession, df
    try:
        stored = spark.read.parquet(f"{folder}/moments")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        have = stored.select(F.col(shard).cast("string").alias("__have")).distinct()
        new = df.join(have, F.col(shard).cast("string") == F.col("__have"), "left_anti")
    moments, buckets = partial_statistics(new, column, shard, error)
    for rows, name in ((buckets, "buckets"), (moments, "moments")):
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(shard).parquet(f"{folder}/{name}")


def merged_statistics(moments: DataFrame, buckets: DataFrame, shares: Sequence[float], error: float = ERROR) -> DataFrame:
    """dim, n, mean, std (population), min, max and an array `quantiles` of all shards together.

    Moments are merged by the deviations of the shards' means. A quantile is the middle of the bucket that holds the value of rank
    floor(share * (n - 1)), at most `error` of its size away from it.
    """
    whole = moments.groupBy("dim").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"))
    apart = moments.join(whole.select(F.col("dim").alias("__dim"), F.col("mean").alias("__mean")), F.col("dim") == F.col("__dim"))
    d = F.col("mean") - F.col("__mean")
    m2 = apart.groupBy(F.col("dim").alias("__d")).agg(F.sum(F.col("m2") + F.col("n") * d * d).alias("m2"))
    summed = buckets.groupBy("dim", "sign", "bucket").agg(F.sum("c").alias("c"))
    order = Window.partitionBy("dim").orderBy("sign", F.col("sign") * F.col("bucket"))
    through = summed.withColumn("through", F.sum("c").over(order))  # a row for each bucket of a dim
    g = _gamma(error)
    value = F.col("sign") * F.pow(F.lit(g), F.col("bucket").cast("double")) * (2 / (g + 1))
    asked = through.join(whole.select(F.col("dim").alias("__dim"), F.col("n").alias("__n"), F.col("min").alias("__lo"), F.col("max").alias("__hi")), F.col("dim") == F.col("__dim"))
    at = F.floor(F.col("q.share") * (F.col("__n") - 1))
    each = asked.withColumn("q", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("share")) for i, x in enumerate(shares)])))
    hit = each.where((F.col("through") > at) & (F.col("through") - F.col("c") <= at))
    quantiles = hit.groupBy(F.col("dim").alias("__q")).agg(F.sort_array(F.collect_list(F.struct("q.i", F.least(F.greatest(value, "__lo"), "__hi").alias("value")))).alias("quantiles"))
    out = whole.join(m2, F.col("dim") == F.col("__d")).join(quantiles, F.col("dim") == F.col("__q"))
    return out.select("dim", "n", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("m2") / F.col("n"))).alias("std"), "min", "max", F.col("quantiles.value").alias("quantiles"))


def stored_statistics(spark: SparkSession, folder: str, shares: Sequence[float], error: float = ERROR) -> DataFrame:
    return merged_statistics(spark.read.parquet(f"{folder}/moments"), spark.read.parquet(f"{folder}/buckets"), shares, error)


def statistics_json(stats: DataFrame) -> DataFrame:
    """(dataset_name, json) with one JSON object per dataset: field -> statistic -> values by dim."""
    names = ("mean", "std", "min", "max", "q01", "q99")
    rows = stats.groupBy("dataset_name", "field", "num_transitions", "num_trajectories").agg(F.sort_array(F.collect_list(F.struct("dim", *names))).alias("s"))
    fields = rows.select("*", F.struct(*[F.col("s").getField(n).alias(n) for n in names]).alias("v"))
    out = fields.groupBy("dataset_name", "num_transitions", "num_trajectories").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "v")))).alias("m"))
    return out.select("dataset_name", F.to_json(F.struct("num_transitions", "num_trajectories", F.col("m").alias("fields"))).alias("json"))


def with_statistics(steps: DataFrame, stats: DataFrame) -> DataFrame:
    """Steps joined to their dataset's arrays: one row per dataset, so the optimizer sends the small side along."""
    return steps.join(stats, "dataset_name")


def require_known(steps: DataFrame, stats: DataFrame) -> DataFrame:
    """Steps with their dataset's arrays; a dataset without statistics is an error when the row is read."""
    joined = steps.join(stats.withColumn("__there", F.lit(True)), "dataset_name", "left")
    checked = F.when(F.col("__there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no statistics for dataset "), F.col("dataset_name"))))
    return joined.where(checked).drop("__there")


def unknown_datasets(steps: DataFrame, stats: DataFrame) -> DataFrame:
    return steps.select("dataset_name").distinct().join(stats.select("dataset_name"), "dataset_name", "left_anti")


def unit_scale(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / (high - low)
