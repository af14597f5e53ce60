"""Filters on steps and whole episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.steps import EPISODE, whole_episode


def successful_path(df: DataFrame, path: str) -> DataFrame:
    """Rows whose path holds 'success' anywhere; so 'unsuccessful' passes too, as in the original rule."""
    return df.where(F.col(path).contains("success"))


def episode_flag(steps: DataFrame, flag: Column, last: bool = False) -> DataFrame:
    """Episodes whose first (or last) row has the flag."""
    value = (F.max_by if last else F.min_by)(flag, F.col("t")).over(whole_episode())
    return steps.withColumn("__flag", value).where("__flag").drop("__flag")


def any_text(steps: DataFrame) -> DataFrame:
    """Episodes in which some step has text."""
    some = F.max(F.coalesce(F.col("language_instruction") != "", F.lit(False)))
    return steps.withColumn("__any", some.over(whole_episode())).where("__any").drop("__any")


def within_magnitude(steps: DataFrame, column: str, most: float) -> DataFrame:
    """Episodes without any absolute value above `most`."""
    fine = F.min(F.forall(column, lambda x: F.abs(x) <= most))
    return steps.withColumn("__fine", fine.over(whole_episode())).where("__fine").drop("__fine")


def nonzero_action(df: DataFrame, window: Column, zero: Column, dims: int, eps: float = 1e-5) -> DataFrame:
    """Rows in whose window some motion dim of some action differs from the normalized zero."""
    moved = F.exists(window, lambda a: F.exists(F.zip_with(F.slice(a, 1, dims), F.slice(zero, 1, dims), lambda x, z: F.abs(x - z) > eps), lambda b: b))
    return df.where(moved)


def idle_filter(chunks: DataFrame, column: str, chunk: int, mode: str = "traj", eps: float = 1e-3) -> DataFrame:
    """Drop idle data. mode "traj": an episode stays if one of its first chunk // 2 chunks differs from its first chunk
    (the rule as it runs); "chunk": a chunk stays if one of its first chunk // 2 actions differs from its first (as documented)."""
    def differs(a: Column, b: Column) -> Column:
        return F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) > eps), lambda d: d)

    half = chunk // 2
    if mode == "chunk":
        return chunks.where(F.exists(F.slice(column, 1, half), lambda a: differs(a, F.col(column)[0])))
    first = F.first(column).over(Window.partitionBy(*EPISODE).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    moved = (F.col("t") < half) & F.exists(F.zip_with(F.col(column), F.col("__first"), lambda a, b: differs(a, b)), lambda d: d)
    return chunks.withColumn("__first", first).withColumn("__moved", F.max(moved).over(whole_episode())).where("__moved").drop("__first", "__moved")


def at_least(steps: DataFrame, length: int, text: bool = True) -> DataFrame:
    """Episodes of `length` steps or more, with text on their first step if asked for."""
    kept = steps.where(F.col("n") >= length)
    return episode_flag(kept, F.trim(F.coalesce("language_instruction", F.lit(""))) != "") if text else kept


def valid_samples(samples: DataFrame, histories: DataFrame, instructions: DataFrame, width: int) -> DataFrame:
    """Samples whose history and instruction exist and whose window has the width."""
    good = histories.where(F.size("action_window") == width).select("action_history_id")
    return samples.join(good, "action_history_id", "left_semi").join(instructions.select("instruction_id"), "instruction_id", "left_semi")


def token_range(df: DataFrame, ids: str, low: int = 31744, high: int = 32000) -> DataFrame:
    return df.where(F.forall(ids, lambda i: i.between(low, high)))


def keep_ranges(frames: DataFrame, ranges: DataFrame | None, key: str = "episode_key") -> DataFrame:
    """Frames inside a range [start, end) of their key; keys without a range are dropped, without a range table all stay."""
    if ranges is None:
        return frames
    r = ranges.select(F.col(key).alias("__key"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    return frames.join(r, (F.col(key) == F.col("__key")) & (F.col("t") >= F.col("__start")) & (F.col("t") < F.col("__end")), "left_semi")


def episode_subset(steps: DataFrame, ids: Sequence[int] | None = None, first: int | None = None) -> DataFrame:
    """Episodes of the given ids, or those of the `first` least ids (found as a bounded, sorted list of episodes)."""
    if ids is not None:
        return steps.where(F.col("episode_id").isin(*ids))
    least = steps.select("episode_id").distinct().orderBy("episode_id").limit(first)
    return steps.join(least, "episode_id", "left_semi")


def column_difference(df: DataFrame, a: str, b: str, atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """same_shape, close and max_diff of two vector columns."""
    diffs = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    close = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda c: F.coalesce(c, F.lit(False)))
    return df.withColumns({"same_shape": F.size(a) == F.size(b), "close": close, "max_diff": F.array_max(diffs)})
