"""Evaluation roll-ups: rollouts, scores, rates, correlations, preferences, tokens, requests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import scratch, written
from .stats import percentiles


def missing_zero(score: Column) -> Column:
    """A score of 0 means that there is none."""
    return F.when(score != 0, score)


def spread(c: str | Column, prefix: str = "") -> list[Column]:
    return [F.avg(c).alias(f"{prefix}mean"), F.stddev_pop(c).alias(f"{prefix}std"), F.min(c).alias(f"{prefix}min"), F.max(c).alias(f"{prefix}max")]


# ---------------------------------------------------------------- scores of episodes
def episode_scores(frames: DataFrame, score: str = "score") -> DataFrame:
    """Per episode mean, min, max, population std and length."""
    return frames.groupBy("episode_id").agg(*spread(score), F.count(F.lit(1)).alias("length"))


def overall_scores(frames: DataFrame, score: str = "score") -> DataFrame:
    """One row: mean, std, min, max and median of episode means, and mean and std of all frames."""
    episodes = written(episode_scores(frames, score), scratch(frames.sparkSession))
    per = episodes.agg(*spread("mean", "episode_"), F.count(F.lit(1)).alias("episodes"))
    median = percentiles(episodes, ["mean"], [0.5]).agg(F.max("value").alias("episode_median"))
    return per.join(F.broadcast(median)).join(F.broadcast(frames.agg(F.avg(score).alias("frame_mean"), F.stddev_pop(score).alias("frame_std"))))  # one row each


def score_percentiles(episodes: DataFrame, score: str, shares: Sequence[float]) -> DataFrame:
    return percentiles(episodes, [score], shares).select("share", "value")


def top_and_bottom(episodes: DataFrame, score: str, n: int, tie: str) -> DataFrame:
    """The n best and n worst episodes, without doubles."""
    best, worst = episodes.orderBy(F.col(score).desc(), tie).limit(n), episodes.orderBy(score, tie).limit(n)
    return best.union(worst).distinct()


def rollout_summary(rollouts: DataFrame) -> DataFrame:
    """Per condition: rollouts, successes, rate, and mean and std of the episodes' mean scores, zeros missing.

    rollouts: condition, success (0/1), score_list.
    """
    sums = F.aggregate("score_list", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + F.when(x != 0, 1).otherwise(0)).alias("n")))
    per = rollouts.withColumn("__a", sums).withColumn("mean_score", F.when(F.col("__a.n") > 0, F.col("__a.s") / F.col("__a.n")))
    by = lambda s: F.when(F.col("success") == s, F.col("mean_score"))
    return per.groupBy("condition").agg(
        F.count(F.lit(1)).alias("total"), F.sum("success").alias("successes"), F.avg("success").alias("rate"), F.avg(by(1)).alias("success_score"), F.avg(by(0)).alias("failure_score"), F.stddev_pop("mean_score").alias("score_std"), F.avg("mean_score").alias("score_mean")
    )


def score_series(frames: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    """Mean and population std by timestep; std only where there is more than one value."""
    out = frames.withColumn("__v", value).groupBy(*by, "t").agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std"))
    return out.withColumn("std", F.when(F.col("n") > 1, F.col("std")))


def rate_vs_score(summary: DataFrame) -> DataFrame:
    """Rate against the mean score weighted by counts; a missing part counts 0 above and in full below the line."""
    total = F.coalesce(F.col("success_score") * F.col("successes"), F.lit(0.0)) + F.coalesce(F.col("failure_score") * (F.col("total") - F.col("successes")), F.lit(0.0))
    return summary.select("condition", "rate", (total / F.col("total")).alias("score"))


def binned_rate(rows: DataFrame, value: str, success: str, bins: int = 10) -> DataFrame:
    """Success rate in equal bins from the least to the greatest value, the last closed; empty bins give 0. With the trend over the others."""
    span = rows.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    placed = rows.join(F.broadcast(span)).withColumn("bin", F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(bins - 1))).cast("int"))
    got = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(success).alias("rate"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left")
    trend = got.agg(F.regr_slope("rate", F.col("bin").cast("double")).alias("slope"), F.regr_intercept("rate", F.col("bin").cast("double")).alias("intercept"))
    return every.join(F.broadcast(trend)).select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rate", F.lit(0.0)).alias("rate"), "slope", "intercept")


# ---------------------------------------------------------------- agreement of two evaluations
def pearson(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation with 1e-8 under the line; 1 where the centred values are equal throughout."""
    means = rows.groupBy(*by).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    joined = rows.join(means, list(by)) if by else rows.join(F.broadcast(means))
    a, b = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my")
    sums = joined.groupBy(*by).agg(F.sum(a * b).alias("xy"), F.sum(a * a).alias("xx"), F.sum(b * b).alias("yy"), F.max(F.abs(a - b)).alias("apart"))
    return sums.select(*by, F.when(F.col("apart") < 1e-12, 1.0).otherwise(F.col("xy") / (F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")) + 1e-8)).alias("pearson"))


def mean_maximum_rank_violation(policies: DataFrame, sim: str, real: str, by: Sequence[str], name: str) -> DataFrame:
    """Mean over policies of the largest real gap to a policy that the simulation puts in the other order.

    Policies of one task are compared with each other: a join on the task, whose policies are few.
    """
    other = policies.select(*by, F.col(name).alias("__n"), F.col(sim).alias("__s"), F.col(real).alias("__r"))
    pairs = policies.join(other, list(by))
    gap = F.when((F.col(sim) > F.col("__s")) != (F.col(real) > F.col("__r")), F.abs(F.col(real) - F.col("__r"))).otherwise(0.0)
    return pairs.groupBy(*by, name).agg(F.max(gap).alias("worst")).groupBy(*by).agg(F.avg("worst").alias("mmrv"))


def kruskal_h(trials: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """Tie-corrected H of two groups of trials; null where all values are equal (then p is 1).

    Mid-ranks come from counts per distinct value, so trials are aggregated before anything is ordered.
    """
    counts = trials.groupBy(*by, group, value).agg(F.count(F.lit(1)).alias("c"))
    ties = counts.groupBy(*by, value).agg(F.sum("c").alias("t"))
    w = Window.partitionBy(*by).orderBy(value)
    ranked = ties.withColumn("mid", F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.col("t") + 1) / 2)
    per_group = counts.join(ranked, [*by, value]).groupBy(*by, group).agg(F.sum(F.col("c") * F.col("mid")).alias("r"), F.sum("c").alias("n"))
    sums = per_group.groupBy(*by).agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").alias("total"))
    tied = ranked.groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tied"))
    n = F.col("total").cast("double")
    h = F.col("s") * 12 / (n * (n + 1)) - (n + 1) * 3
    right = F.lit(1.0) - F.col("tied") / (n * n * n - n)
    return sums.join(tied, list(by)).select(*by, F.when(right > 0, h / right).alias("h"))


def chi2_tail(h: Column) -> Column:
    """P(chi-square of one degree > h) = erfc(sqrt(h / 2)); 1 where h is null. Python's erfc over Arrow batches of the few results."""
    @F.pandas_udf("double")
    def tail(x):
        from math import erfc, isnan, sqrt

        return x.map(lambda v: 1.0 if v is None or isnan(v) else erfc(sqrt(max(v, 0.0) / 2)))

    return tail(h)


def rebuilt_trials(rates: DataFrame, trials: str, rate: str) -> DataFrame:
    """0/1 rows of a rate and a number of trials: round(n * rate) ones; a missing rate counts as 0."""
    ones = F.round(F.col(trials) * F.coalesce(rate, F.lit(0.0)))
    return rates.select("*", F.explode(F.sequence(F.lit(1), F.col(trials))).alias("__i")).withColumn("outcome", (F.col("__i") <= ones).cast("int")).drop("__i")


def mean_of_means(rows: DataFrame, value: Column, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Averages of averages: over the first level's keys, then over each coarser level's."""
    out = rows.withColumn("rate", value)
    for keys in levels:
        out = out.groupBy(*keys).agg(F.avg("rate").alias("rate"))
    return out


# ---------------------------------------------------------------- tokens, preferences, requests
def token_metrics(rows: DataFrame, by: Sequence[str], order: str, predicted: str, truth: str, action_dim: int, ignore: int = -100) -> DataFrame:
    """Token accuracy of the current action (the first action_dim unmasked tokens) and of the later ones."""
    place = F.sum((F.col(truth) != ignore).cast("int")).over(Window.partitionBy(*by).orderBy(order))
    marked = rows.withColumns({"__p": place, "__ok": (F.col(predicted) == F.col(truth)).cast("double")}).where(F.col(truth) != ignore)
    now = F.col("__p") <= action_dim
    return marked.groupBy(*by).agg(F.avg(F.when(now, F.col("__ok"))).alias("current_accuracy"), F.avg(F.when(~now, F.col("__ok"))).alias("next_accuracy"), F.count(F.lit(1)).alias("n_tokens"))


def windowed_means(rows: DataFrame, by: str, order: str, values: Sequence[str], size: int) -> DataFrame:
    """Means over the last `size` rows of each group, and of the last `size` rows of all, as group 'overall'."""
    last = rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).where(F.col("__r") <= size)
    per = last.groupBy(by).agg(*[F.avg(v).alias(v) for v in values])
    overall = rows.orderBy(F.col(order).desc()).limit(size).agg(*[F.avg(v).alias(v) for v in values]).select(F.lit("overall").alias(by), *values)
    return per.unionByName(overall)


def preference_metrics(rows: DataFrame, first: str, second: str, preferred: str) -> DataFrame:
    """Accuracy of score0 >= score1 against a preference of 1 or 2, share predicted first, mean score."""
    guess = F.col(first) - F.col(second) >= 0
    return rows.agg(F.avg((guess == (F.col(preferred) == 1)).cast("double")).alias("accuracy"), F.avg(guess.cast("double")).alias("label_positive_rate"), F.avg((F.col(first) + F.col(second)) / 2).alias("average_score"))


def preference_loss(rows: DataFrame, chosen: str, rejected: str, gap: str, alpha: float) -> DataFrame:
    """Mean of -log sigmoid(chosen - rejected) and of alpha * (gap - difference)**2."""
    d = F.col(chosen) - F.col(rejected)
    return rows.agg(F.avg(F.log1p(F.exp(-d))).alias("ranking"), F.avg((F.col(gap) - d) * (F.col(gap) - d) * alpha).alias("penalty")).withColumn("loss", F.col("ranking") + F.col("penalty"))


def request_metrics(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Throughput and latencies of the successful requests of a log.

    log: success, prompt_len, output_len, latency, ttft, started; time per output token only for outputs over one token.
    """
    good = log.where("success")
    tpot = F.when(F.col("output_len") > 1, (F.col("latency") - F.col("ttft")) / (F.col("output_len") - 1))
    rows, columns = good.withColumn("tpot", tpot), ("ttft", "tpot", "latency")
    times = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    span = F.max(F.col("started") + F.col("latency")) - F.min("started")
    whole = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("completed"), F.sum("prompt_len").alias("total_input"), F.sum("output_len").alias("total_output"), (F.count(F.lit(1)) / span).alias("request_throughput"), (F.sum("output_len") / span).alias("output_throughput"), *times
    )
    places = [F.max(F.when((F.col("name") == c) & (F.col("share") == q), F.col("value"))).alias(f"{n}_{c}") for c in columns for n, q in (("median", 0.5), ("p99", 0.99))]
    keys = [F.col(c).alias(f"__{c}") for c in by]
    ranks = percentiles(rows, columns, (0.5, 0.99), by).groupBy(*by).agg(*places).select(*keys, *[f"{n}_{c}" for c in columns for n in ("median", "p99")])
    if not by:
        return whole.join(F.broadcast(ranks))  # one row each
    return whole.join(ranks, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]), "left").drop(*[f"__{c}" for c in by])


def metric_table(rows: DataFrame, name: str, value: str) -> DataFrame:
    return rows.groupBy(name).agg(*spread(value), F.count(F.lit(1)).alias("n"))


def pass_at_k(samples: DataFrame, task: str, passed: str, ks: Sequence[int]) -> DataFrame:
    """1 - prod(1 - k / i for i in n - c + 1 .. n), for each k that the task's n samples allow."""
    per = samples.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(passed).cast("long")).alias("c"))
    each = per.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("n >= k")
    product = F.aggregate(F.sequence(F.col("n") - F.col("c") + 1, F.col("n")), F.lit(1.0), lambda p, i: p * (F.lit(1.0) - F.col("k") / i))
    return each.select(task, "k", F.when(F.col("c") == 0, 0.0).when(F.col("n") - F.col("c") < F.col("k"), 1.0).otherwise(F.lit(1.0) - product).alias("pass_at_k"))


def majority_vote(answers: DataFrame, question: str, answer: str, order: str) -> DataFrame:
    """The most frequent answer of each question, the one seen first on ties; of answers seen at once the least."""
    counts = answers.where(F.col(answer).isNotNull()).groupBy(question, answer).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(question).agg(F.min_by(answer, F.struct(-F.col("n"), F.col("seen"), F.col(answer))).alias("voted"))
