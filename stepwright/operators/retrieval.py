"""Retrieval of the true window or view among candidates, and triangle-area alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, minus, norm
from ..functions.keyed import draw, numbered
from ..sources.storage import scratch, written
from .stats import percentiles


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """Area of the triangle of three points, from dot products of two sides (Lagrange's identity)."""
    u, v = minus(b, a), minus(c, a)
    uv = dot(u, v)
    return F.sqrt(F.greatest(F.lit(0.0), dot(u, u) * dot(v, v) - uv * uv)) / 2


def in_batch(left: DataFrame, right: DataFrame, batch: str) -> DataFrame:
    """All pairs within a batch: an equality join on it, so at most the square of a batch's size."""
    r = right.select(F.col(batch).alias("__b"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != batch])
    return left.join(r, F.col(batch) == F.col("__b")).drop("__b")


def triangle_areas(rows: DataFrame, batch: str, index: str, anchor: str, first: str, second: str) -> DataFrame:
    """Area of (anchor_i, first_j, second_j) for all i, j of a batch."""
    pairs = in_batch(rows.select(batch, index, anchor), rows.select(batch, index, first, second), batch)
    return pairs.select(batch, F.col(index).alias("i"), F.col(f"r_{index}").alias("j"), triangle_area(F.col(anchor), F.col(f"r_{first}"), F.col(f"r_{second}")).alias("area"))


def triangle_retrieval(rows: DataFrame, batch: str, index: str, first: str, second: str, candidate: str) -> DataFrame:
    """For each (first_i, second_i) the candidate_j of least area, the lower j on ties, and whether it is i's own."""
    pairs = in_batch(rows.select(batch, index, first, second), rows.select(batch, index, candidate), batch)
    area = triangle_area(F.col(first), F.col(second), F.col(f"r_{candidate}"))
    best = pairs.groupBy(batch, index).agg(F.min_by(f"r_{index}", F.struct(F.round(area, 9).alias("a"), F.col(f"r_{index}").alias("j"))).alias("retrieved"))
    return best.withColumn("correct", F.col("retrieved") == F.col(index))


def triangle_loss(areas: DataFrame, batch: str, smoothing: float = 0.0, temperature: float = 1.0) -> DataFrame:
    """Per batch the mean of both directions' cross entropy of -area / temperature, the true pair at i = j, with label smoothing."""
    z = areas.withColumn("z", -F.col("area") / temperature)

    def direction(own: str) -> DataFrame:
        w = z.groupBy(batch, own).agg(F.log(F.sum(F.exp("z"))).alias("lse"), F.avg("z").alias("mean_z"), F.max(F.when(F.col("i") == F.col("j"), F.col("z"))).alias("true_z"))
        loss = F.col("lse") - F.col("true_z") * (1 - smoothing) - F.col("mean_z") * smoothing
        return w.groupBy(batch).agg(F.avg(loss).alias(f"loss_{own}"))

    both = direction("i").join(direction("j"), batch)
    return both.select(batch, "loss_i", "loss_j", ((F.col("loss_i") + F.col("loss_j")) / 2).alias("loss"))


def ranks_of_truth(pool: DataFrame, query: str, candidate: str, score: str, truth: str) -> DataFrame:
    """Place of the true candidate by descending score, ties by candidate; and by scores strictly above it."""
    order = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), candidate))
    ties = F.rank().over(Window.partitionBy(query).orderBy(F.col(score).desc()))
    placed = pool.withColumns({"place": order, "strict": ties})
    return placed.where(F.col(candidate) == F.col(truth)).select(query, "place", "strict")


def retrieval_summary(ranks: DataFrame, cuts: Sequence[int] = (1, 2, 3, 4, 5, 10, 20)) -> DataFrame:
    """One row: top shares at the cuts, mean and median rank."""
    shares = [F.avg((F.col("place") <= k).cast("double")).alias(f"top_{k}") for k in cuts]
    held = written(ranks.select("place"), scratch(ranks.sparkSession))
    median = percentiles(held, ["place"], [0.5]).agg(F.max("value").alias("median_rank"))
    return held.agg(F.count(F.lit(1)).alias("queries"), *shares, F.avg("place").alias("mean_rank")).join(F.broadcast(median))  # one row each


def top_k_both_ways(scores: DataFrame, batch: str, ks: Sequence[int]) -> DataFrame:
    """Per batch the share of rows (and of columns) whose true partner is among the k best; null where k exceeds the batch.

    scores: batch, i, j, score.
    """
    by = lambda a, b: F.row_number().over(Window.partitionBy(batch, a).orderBy(F.col("score").desc(), b))
    placed = scores.withColumns({"row_place": by("i", "j"), "column_place": by("j", "i")}).where("i = j")
    size = F.count(F.lit(1))
    out = []
    for k in ks:
        for n, c in (("rows", "row_place"), ("columns", "column_place")):
            out.append(F.when(size >= k, F.avg((F.col(c) <= k).cast("double"))).alias(f"{n}_top_{k}"))
    return placed.groupBy(batch).agg(*out)


def negative_pool(queries: DataFrame, candidates: DataFrame, key: str, content: str, n: int, seed: int = 0) -> DataFrame:
    """n keyed negatives of each query (all if there are fewer), none with its content.

    Candidates are numbered by content, in keyed order within one, so a content is a run of numbers. Of the numbers outside a
    query's own run n equal parts give one each, by a keyed draw, behind a keyed turn of them all: each draw hits, and no two are
    the same. Work grows with the queries alone, whatever share of the candidates a content has.
    """
    order = [F.col("__content"), draw(F.col("negative"), seed), F.col("negative")]
    placed = written(numbered(candidates.select(F.col(key).alias("negative"), F.col(content).alias("__content")), order, "__number"), scratch(candidates.sparkSession))
    runs = placed.groupBy("__content").agg(F.min("__number").alias("__start"), F.count(F.lit(1)).alias("__length"))
    total = placed.agg(F.count(F.lit(1)).alias("__total"))
    own = queries.select(key, content).join(runs, F.col(content).eqNullSafe(F.col("__content")), "left").join(F.broadcast(total))  # one row
    others = own.withColumn("__others", F.col("__total") - F.coalesce("__length", F.lit(0))).withColumn("__asked", F.least(F.lit(n), F.col("__others")))
    tries = others.where("__asked > 0").withColumn("__try", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__asked") - 1)))
    edge = lambda i: F.expr(f"(({i}) * __others) div __asked")
    pick = edge("__try") + F.floor(draw(F.col(key) * n + F.col("__try"), seed + 1) * (edge("__try + 1") - edge("__try")))
    turned = (pick + F.floor(draw(F.col(key), seed + 2) * F.col("__others"))) % F.col("__others")
    at = F.when(turned < F.coalesce("__start", F.col("__total")), turned).otherwise(turned + F.coalesce("__length", F.lit(0)))
    drawn = tries.select(key, at.alias("__at"))
    return drawn.join(placed.select("negative", "__number"), F.col("__at") == F.col("__number")).select(key, "negative")


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def verified_embeddings(steps: DataFrame, trajectory: str, views: Sequence[str], k: int, tolerance: float = 0.05) -> DataFrame:
    """Per trajectory its length, the largest deviation of a view's norm from 1, whether that is small, and whether it is longer than k."""
    off = F.array_max(F.array(*[F.coalesce(F.abs(norm(F.col(v)) - 1), F.lit(0.0)) for v in views]))
    per = steps.groupBy(trajectory).agg(F.count(F.lit(1)).alias("length"), F.max(off).alias("deviation"))
    return per.withColumns({"unit": F.col("deviation") < tolerance, "temporal": F.col("length") > k})
