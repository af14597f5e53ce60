"""Mixtures of datasets, splits, shards and samples; every choice is keyed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keyed import draw, numbered, ranked
from ..sources.storage import scratch, written


# ---------------------------------------------------------------- weights and quotas
def mixture_weights(members: DataFrame, balance: bool = True) -> DataFrame:
    """members (dataset_name, weight, n) with `share`, which sums to 1; balanced by size if asked for."""
    w = F.col("weight") * F.col("n") if balance else F.col("weight")
    total = members.agg(F.sum(w).alias("__total"))
    return members.join(F.broadcast(total)).select(*members.columns, (w / F.col("__total")).alias("share"))  # one row


def effective_length(members: DataFrame) -> DataFrame:
    """int(max(n / share)) over members whose given weight is exactly 1; null if there is none."""
    return mixture_weights(members).agg(F.floor(F.max(F.when(F.col("weight") == 1.0, F.col("n") / F.col("share")))).alias("effective_length"))


def apportioned(shares: DataFrame, total: int, order: str, share: str = "share") -> DataFrame:
    """Whole quotas that sum to `total`, at least one each: shares of what is left after the sure ones, largest remainders first.

    One row per dataset of a mixture: a short list, ordered in one window.
    """
    sure = shares.withColumn("__low", (F.col(share) * total < 1).cast("int"))
    held = F.sum("__low").over(Window.partitionBy())
    rest = F.sum(F.when(F.col("__low") == 0, F.col(share))).over(Window.partitionBy())
    exact = F.when(F.col("__low") == 1, F.lit(1.0)).otherwise(F.col(share) / rest * (F.lit(total) - held))
    made = sure.withColumn("__exact", exact).withColumn("__floor", F.greatest(F.lit(1), F.floor("__exact")))
    left = F.lit(total) - F.sum("__floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy().orderBy((F.col("__exact") - F.floor("__exact")).desc(), order))
    out = made.withColumn("__left", left).withColumn("quota", (F.col("__floor") + (rank <= F.col("__left")).cast("int")).cast("long"))
    return out.drop("__low", "__exact", "__floor", "__left")


def dedup_members(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members of a mixture once each, the first entry of a name, without names that are not known."""
    first = members.withColumn("__n", F.row_number().over(Window.partitionBy("dataset_name").orderBy("position"))).where("__n = 1").drop("__n")
    return first.join(known.select("dataset_name"), "dataset_name", "left_semi")


def numbered_members(rows: DataFrame, key: Column, ties: list[str], seed: int = 0) -> DataFrame:
    """Add `number` (from 0) of each row in its dataset, in keyed order, and `size`, the dataset's rows."""
    placed = numbered(rows, ["dataset_name", draw(key, seed), *ties], "__at")
    starts = placed.groupBy("dataset_name").agg(F.min("__at").alias("__start"), F.count(F.lit(1)).alias("size"))
    # a row for each dataset of a mixture: a short list, sent along by the optimizer if it finds it so
    return placed.join(starts, "dataset_name").withColumn("number", F.col("__at") - F.col("__start")).drop("__at", "__start")


def mixture_sample(rows: DataFrame, quotas: DataFrame, key: Column, ties: list[str], seed: int = 0) -> DataFrame:
    """`quota` rows of each dataset: whole copies of it, then the rows that come first by the key.

    Rows are numbered in range-sorted parts, so a giant dataset is numbered in many tasks.
    """
    q = numbered_members(rows, key, ties, seed).join(quotas.select("dataset_name", "quota"), "dataset_name")
    whole = F.floor(F.col("quota") / F.col("size"))
    copies = (whole + (F.col("number") < F.col("quota") - whole * F.col("size")).cast("int")).cast("int")
    out = q.withColumn("copies", copies).where("copies > 0")
    return out.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def interleaved(rows: DataFrame, shares: Sequence[tuple[str, float]], total: int, key: Column, ties: list[str], seed: int = 0, block: int = 65_536) -> DataFrame:
    """`total` rows of a mixture in order: `position` (from 0), `epoch` (from 0) and the row.

    A draw keyed by the position picks its dataset by the shares (dataset, weight), so shares hold in every prefix as in any sample; how
    many positions before it took the same dataset says which of the dataset's rows it is, in keyed order. A dataset that
    is used up begins its next epoch. Datasets without rows get no positions. Positions are counted in blocks, so no window holds them all.
    """
    spark = rows.sparkSession
    members = numbered_members(rows, key, ties, seed)
    sizes = written(members.groupBy("dataset_name").agg(F.max("size").alias("__size")), scratch(spark))
    there = {r["dataset_name"] for r in sizes.where(F.col("dataset_name").isin([d for d, _ in shares])).select("dataset_name").collect()}  # of the given list
    given = [(d, w) for d, w in shares if d in there and w > 0]
    if not given:
        raise ValueError("no dataset of the mixture has rows")
    whole, upto, pick = sum(w for _, w in given), 0.0, None
    u = F.col("__u")
    for d, w in given[:-1]:
        upto += w
        pick = F.when(u < upto / whole, F.lit(d)) if pick is None else pick.when(u < upto / whole, F.lit(d))
    last = F.lit(given[-1][0])
    drawn = spark.range(total).withColumn("__u", draw(F.col("id"), seed + 1)).select(F.col("id").alias("position"), F.floor(F.col("id") / block).alias("__block"), (last if pick is None else pick.otherwise(last)).alias("__d"))
    counts = drawn.groupBy("__d", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__d").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("__d").alias("__d2"), F.col("__block").alias("__b2"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__d", "__block").orderBy("position")) - 1
    placed = drawn.withColumn("__inside", inside).join(starts, (F.col("__d") == F.col("__d2")) & (F.col("__block") == F.col("__b2")))
    nth = F.col("__before") + F.col("__inside")
    sized = placed.join(sizes.withColumnRenamed("dataset_name", "__d3"), F.col("__d") == F.col("__d3"))
    turns = sized.select("position", "__d", F.floor(nth / F.col("__size")).cast("long").alias("epoch"), (nth % F.col("__size")).alias("__number"))
    return turns.join(members, (F.col("__d") == F.col("dataset_name")) & (F.col("__number") == F.col("number"))).select("position", "epoch", *rows.columns)


def buffer_shuffled(rows: DataFrame, position: str, buffer: int, seed: int = 0) -> DataFrame:
    """Rows whose dense `position` (from 0) is changed as by a shuffle buffer: no row moves by `buffer` places or more.

    Positions are permuted by keyed draws inside blocks of half the buffer, then inside blocks shifted by half of that, so rows
    cross the borders of the first. Two windows over blocks, no sort of the table.
    """
    size = max(1, buffer // 2)

    def permuted(df: DataFrame, shift: int, salt: int) -> DataFrame:
        at = F.col(position) + shift
        cut = df.withColumn("__block", F.floor(at / size)).withColumn("__u", draw(F.col(position), salt))
        w = Window.partitionBy("__block")
        place = F.min(position).over(w) + F.row_number().over(w.orderBy("__u", position)) - 1
        return cut.withColumn(position, place.cast("long")).drop("__block", "__u")

    return permuted(permuted(rows, 0, seed), size // 2, seed + 1)


# ---------------------------------------------------------------- splits and shards
def split_episodes(steps: DataFrame, episode: Column, validation: float = 0.05, named: str | None = None, fallback: bool = True, seed: int = 0) -> DataFrame:
    """Add `split`: the named column's value where it is given, else a keyed share of whole episodes.

    With fallback=False a table without a named split is an error.
    """
    if named is not None and named in steps.columns:
        return steps.withColumn("split", F.col(named))
    if not fallback:
        raise ValueError("the table names no split")
    return steps.withColumn("split", F.when(draw(episode, seed) < 1 - validation, "train").otherwise("val"))


def split_fraction(rows: DataFrame, key: Column, ties: list[str], fraction: float, seed: int = 0) -> DataFrame:
    """Add `split`: exactly int(fraction * n) rows are val, by keyed order."""
    n = rows.count()
    placed = ranked(rows, draw(key, seed), ties, "__rank")
    return placed.withColumn("split", F.when(F.col("__rank") <= int(fraction * n), "val").otherwise("train")).drop("__rank")


def split_multiple(rows: DataFrame, unit: Column, ties: list[str], evaluation: int, multiple: int = 32) -> DataFrame:
    """train and eval parts in order, each of a whole multiple of rows; rows left over are in neither (null)."""
    n = rows.count()
    train, held = (n - evaluation) // multiple * multiple, evaluation // multiple * multiple
    placed = ranked(rows, unit, ties, "__rank")
    return placed.withColumn("split", F.when(F.col("__rank") <= train, "train").when(F.col("__rank") > n - held, "eval")).drop("__rank")


def assigned_shard(rows: DataFrame, key: Column, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int"))


def write_shards(rows: DataFrame, path: str, shard: str = "shard", start: int = 0) -> None:
    """One folder per shard; a rerun overwrites only the shards from `start` on that it writes."""
    todo = rows.where(F.col(shard) >= start).repartition(shard)
    todo.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(shard).parquet(path)


def chunk_of(rows: DataFrame, unit: Column, ties: list[str], n: int) -> DataFrame:
    """Add `chunk`: n chunks of ceil(N / n) rows in order."""
    size = -(-rows.count() // n) or 1
    placed = ranked(rows, unit, ties, "__rank")
    return placed.withColumn("chunk", F.floor((F.col("__rank") - 1) / size).cast("int")).drop("__rank")


# ---------------------------------------------------------------- samples and order
def subsample_steps(steps: DataFrame, key: Column, n: int, seed: int = 0) -> DataFrame:
    """n steps of each episode at most, by the key."""
    w = Window.partitionBy("dataset_name", "episode_id").orderBy(draw(key, seed), "t")
    return steps.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def uniform_rows(rows: DataFrame, key: Column, ties: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: the first by the key."""
    return rows.withColumn("__u", draw(key, seed)).orderBy("__u", *ties).limit(n).drop("__u")


def validation_rows(rows: DataFrame, key: Column, ties: list[str], n: int, seed: int = 0) -> DataFrame:
    """The first n rows in keyed order, written once: every evaluation reads the same rows, and none draws them again."""
    return written(uniform_rows(rows, key, ties, n, seed), scratch(rows.sparkSession))


def global_shuffle(rows: DataFrame, key: Column, ties: list[str], seed: int = 0) -> DataFrame:
    """Add `position`, a keyed order of the whole table."""
    return ranked(rows, draw(key, seed), ties, "position")


def swapped_cameras(steps: DataFrame, a: str, b: str, episode: Column, seed: int = 0) -> DataFrame:
    """The two columns change places in half of the episodes."""
    swap = draw(episode, seed) < 0.5
    return steps.withColumns({a: F.when(swap, F.col(b)).otherwise(F.col(a)), b: F.when(swap, F.col(a)).otherwise(F.col(b))})


def first_camera(*views: Column) -> Column:
    """The first view that is not empty."""
    return F.coalesce(*[F.when(F.length(v) > 0, v) for v in views])


def unique_actions(df: DataFrame, group: list[str], ids: str, order: str) -> DataFrame:
    """Of rows with equal token ids in a group the first."""
    first = F.row_number().over(Window.partitionBy(*group, ids).orderBy(order))
    return df.withColumn("__r", first).where("__r = 1").drop("__r")


def best_of_n(candidates: DataFrame, group: list[str], score: str, index: str, current: str | None = None, below: float | None = None, least: bool = False) -> DataFrame:
    """The best candidate of each group, the first on ties. With a threshold only where the current score is below it; else index 0 stays."""
    place = F.struct(F.col(score) if least else -F.col(score), F.col(index))
    best = candidates.groupBy(*group).agg(F.min_by(F.struct(*[c for c in candidates.columns if c not in group]), place).alias("best"), F.min_by(F.struct(*[c for c in candidates.columns if c not in group]), F.col(index)).alias("stay"), *([F.first(current).alias("__now")] if current else []))
    chosen = F.col("best") if current is None else F.when(F.col("__now") < below, F.col("best")).otherwise(F.col("stay"))
    return best.select(*group, chosen.alias("c")).select(*group, "c.*")


def length_batches(rows: DataFrame, modality: str, length: str, key: Column, ties: list[str], batch: int, replicas: int, seed: int = 0) -> DataFrame:
    """Batches of one modality and of like lengths, dealt evenly over replicas.

    Rows of a modality are shuffled by key and cut in batches (the last is filled from the first rows); in a batch the
    longest go first, each to the replica with the least length so far that has room. The dealing looks at one batch at a time.
    `turn` (from 0) is the order in which batches are sent: that with the longest row first, so that memory runs out at once if at all, the others in keyed order.
    """
    import pandas as pd

    if batch % replicas:
        raise ValueError(f"{replicas} replicas do not share batches of {batch} evenly")

    parts = []
    for m in (True, False):
        own = rows.where(F.col(modality) == m)
        n = own.count()
        if not n:
            continue
        placed = ranked(own, draw(key, seed), ties, "__rank")
        batches = -(-n // batch)
        lacking = batches * batch - n
        cut = placed.withColumn("batch", F.floor((F.col("__rank") - 1) / batch).cast("int"))
        fill = placed.where(F.col("__rank") <= lacking).withColumn("batch", F.lit(batches - 1).cast("int")) if lacking else None
        parts.append(cut if fill is None else cut.unionByName(fill))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def dealt(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values([length, *ties], ascending=[False, *[True] * len(ties)])
        loads, room, chosen = [0] * replicas, [batch // replicas] * replicas, []
        for x in one[length]:
            r = min((i for i in range(replicas) if room[i]), key=lambda i: loads[i])
            loads[r] += int(x)
            room[r] -= 1
            chosen.append(r)
        return one.assign(replica=chosen)

    schema = T.StructType([*every.schema.fields, T.StructField("replica", T.IntegerType())])
    each = every.groupBy(modality, "batch").agg(F.max(F.struct(F.col(length))).alias("__most"))
    longest = each.agg(F.max(F.struct("__most", -F.col("batch"), F.col(modality))).alias("__top"))
    first = (F.col("__most") == F.col("__top.__most")) & (-F.col("batch") == F.col("__top.col2")) & (F.col(modality) == F.col(f"__top.{modality}"))
    mixed = draw(F.col("batch") * 2 + F.col(modality).cast("int"), seed + 1)
    turns = numbered(each.join(F.broadcast(longest)), [F.when(first, 0).otherwise(1), mixed, "batch", modality], "turn").select(F.col("batch").alias("__b"), F.col(modality).alias("__m"), "turn")
    out = every.groupBy(modality, "batch").applyInPandas(dealt, schema).drop("__rank")
    return out.join(turns, (F.col("batch") == F.col("__b")) & (F.col(modality) == F.col("__m"))).drop("__b", "__m")


def permuted_choices(rows: DataFrame, options: str, correct: int, key: Column, repeats: int, letters: str = "ABCD", seed: int = 0) -> DataFrame:
    """Each question `repeats` times with its options in keyed order, and the letter of the option that was at `correct`."""
    many = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    place = lambda i: draw(key * 31 + F.col("repeat") * 7 + i, seed)
    mixed = many.withColumn("__o", F.array_sort(F.transform(options, lambda o, i: F.struct(place(i).alias("u"), i.alias("i"), o.alias("o")))))
    at = F.array_position(F.transform("__o", lambda r: r["i"]), correct).cast("int")
    return mixed.withColumns({"permuted": F.transform("__o", lambda r: r["o"]), "letter": F.substring(F.lit(letters), at, F.lit(1))}).drop("__o")
