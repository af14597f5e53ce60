"""Joins of trajectories, tasks, rephrase sets and answers by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import draw


def enriched(left: DataFrame, right: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All left rows with the columns of the first right row of their key (by `order`); null where there is none."""
    first = right.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__r")).select(F.col(key).alias("__key"), "__r.*")
    return left.join(first, F.col(key) == F.col("__key"), "left").drop("__key")


def aligned_sets(sets: dict[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Rows whose keys are present in all sets, one value column per set."""
    out = None
    for name, df in sets.items():
        one = df.select(*keys, F.col(value).alias(name))
        out = one if out is None else out.join(one, list(keys))
    return out


def present_tasks(df: DataFrame, tasks: DataFrame, key: Column, other: Column) -> DataFrame:
    """Rows whose normalized name is among the tasks' normalized names."""
    names = tasks.select(other.alias("__name")).distinct()
    return df.withColumn("__key", key).join(names, F.col("__key") == F.col("__name"), "left_semi").drop("__key")


def combined_rates(sources: dict[str, DataFrame | None], task: str, rate: str) -> DataFrame:
    """One row per task of any source, a rate column per source; sources may be absent."""
    there = {n: d.select(F.col(task).alias(task), F.col(rate).alias(n)) for n, d in sources.items() if d is not None}
    out = None
    for d in there.values():
        out = d if out is None else out.join(d, task, "full_outer")
    return out


def missing_files(references: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Referenced paths that are not among the files."""
    return references.select(path).distinct().join(files.select(path), path, "left_anti")


def video_frames(frames: DataFrame, episodes: DataFrame, fps: float) -> DataFrame:
    """Index of each frame in its video: round(from_timestamp * fps) + frame_index, halves to even."""
    return frames.join(episodes.select("episode_id", "from_timestamp"), "episode_id").withColumn("video_frame", (F.bround(F.col("from_timestamp") * fps) + F.col("frame_index")).cast("long"))


# ---------------------------------------------------------------- answers to questions
def letter_answer(text: Column) -> Column:
    """Letter after 'Answer:' in a text, upper case; null if none."""
    got = F.regexp_extract(text, r"(?i)Answer\s*:\s*([A-D])", 1)
    return F.when(got != "", F.upper(got))


def option_index(text: Column, options: str, key: Column, seed: int = 0) -> Column:
    """Place of the one letter that a text names (alone, or as 'The answer is X.'); if unclear a keyed choice."""
    alone = F.when(F.length(text) == 1, F.upper(text))
    named = F.regexp_extract_all(text, F.lit(r"The answer is ([A-Z])\."), F.lit(1))
    letter = F.coalesce(alone, F.when(F.size(named) == 1, named[0]))
    at = F.instr(F.lit(options), letter) - 1
    return F.when(letter.isNotNull() & (at >= 0), at).otherwise(F.floor(draw(key, seed) * len(options)).cast("int"))


def joined_answers(questions: DataFrame, systems: dict[str, DataFrame], key: str, value: str, required: bool = True) -> DataFrame:
    """Questions with one answer column per system; those without an answer of some system are dropped if required."""
    out = questions
    for name, df in systems.items():
        out = out.join(df.select(key, F.col(value).alias(name)), key, "inner" if required else "left")
    return out


def ensemble_accuracy(rows: DataFrame, ours: str, other: str, truth: str) -> DataFrame:
    """Accuracy of either system, of the other with ours where it has no answer, and if the better were known."""
    right = lambda c: F.coalesce((F.col(c) == F.col(truth)), F.lit(False)).cast("double")
    fallback = F.coalesce(other, ours)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(right(ours)).alias("ours"), F.avg(right(other)).alias("other"), F.avg((fallback == F.col(truth)).cast("double")).alias("fallback"), F.avg(F.greatest(right(ours), right(other))).alias("upper_bound")
    )


def prefix_answer(text: Column, prefix: Column) -> Column:
    """Last number after the last occurrence of a prefix: no thousands commas, no trailing point or zeros; '' if there is none."""
    rest = F.element_at(F.split(text, F.concat(F.lit("\\Q"), prefix, F.lit("\\E"))), -1)
    number = F.try_element_at(F.regexp_extract_all(F.replace(rest, F.lit(","), F.lit("")), F.lit(r"(\d+\.?\d*)"), F.lit(1)), F.lit(-1))
    plain = F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text.contains(prefix), F.coalesce(plain, F.lit(""))).otherwise("")


def grouped_accuracy(rows: DataFrame, groups: Column, correct: Column) -> DataFrame:
    """Accuracy per value of an array of groups, and of all."""
    scored = rows.withColumn("__c", correct.cast("double"))
    per = scored.select(F.explode(groups).alias("group"), "__c")
    every = scored.select(F.lit("all").alias("group"), "__c")
    return per.union(every).groupBy("group").agg(F.avg("__c").alias("accuracy"), F.count(F.lit(1)).alias("n"))


def contains_all(text: Column, words: Column) -> Column:
    return F.forall(F.split(words, " "), lambda w: text.contains(w))


def any_number(text: Column, truth: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    return F.array_contains(found, truth.cast("string"))


def review_ratio(reviews: DataFrame, category: str, first: str, second: str) -> DataFrame:
    """Mean scores per category and for all, and the second as a percentage of the first, in whole numbers."""
    means = [F.avg(first).alias("mean_first"), F.avg(second).alias("mean_second")]
    both = reviews.groupBy(category).agg(*means).unionByName(reviews.agg(*means).select(F.lit("all").alias(category), "mean_first", "mean_second"))
    return both.withColumn("ratio", F.round(F.col("mean_second") / F.col("mean_first") * 100))


# ---------------------------------------------------------------- choices by log probability
def choice_by_mean(choices: DataFrame, group: str, index: str, logprobs: str, baseline: str | None = None) -> DataFrame:
    """The choice of greatest mean token log probability, less that of the baseline tokens if given; the first on ties."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    score = mean(logprobs) - (mean(baseline) if baseline else F.lit(0.0))
    return choices.groupBy(group).agg(F.min_by(index, F.struct(F.round(-score, 9).alias("s"), F.col(index))).alias("chosen"))


def choice_greedy(choices: DataFrame, group: str, index: str, logprobs: str) -> DataFrame:
    """Token by token the choices of greatest log probability stay; a choice that has ended counts with its mean.

    The choices of one request, a small group, are folded place by place; the first of equals is chosen.
    """
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.size(p)
    value = lambda c, place: F.coalesce(F.get(c["path"], place), mean(c["path"]))
    paths = choices.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(index).cast("int").alias("i"), F.col(logprobs).alias("path")))).alias("paths"))
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.array_max(F.transform("paths", lambda c: F.size(c["path"]))) - 1))
    best = lambda left, place: F.array_max(F.transform(left, lambda c: value(c, place)))
    left = F.aggregate(places, F.col("paths"), lambda s, place: F.filter(s, lambda c: value(c, place) == best(s, place)))
    return paths.select(group, left[0]["i"].alias("chosen"))
