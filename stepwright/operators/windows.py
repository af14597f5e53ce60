"""Windows over an episode: padded action windows, k-step pairs, gripper and goal relabelling.

All take steps (dataset_name, episode_id, t, n, action, ...) and share one window specification.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.keyed import draw
from ..sources.steps import EPISODE, episode_window, renumbered, whole_episode

PAD = -5.0


def gathered(column: str, before: int, after: int) -> Column:
    return F.collect_list(column).over(episode_window().rowsBetween(-before, after))


def padded_window(steps: DataFrame, before: int, after: int, pad: str = "value", value: float = PAD, column: str = "action", out: str = "action_window") -> DataFrame:
    """Add rows t - before to t + after as an array; what lies outside the episode is filled.

    pad: "value" with a constant vector, "edge" with the episode's first or last row, "last" with the last row
    behind and a constant in front.
    """
    width = F.size(column)
    constant = F.array_repeat(F.lit(float(value)), width)
    full = whole_episode().orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    front = F.first(column).over(full) if pad == "edge" else constant
    back = F.last(column).over(full) if pad in ("edge", "last") else constant
    lacking_before = F.greatest(F.lit(0), F.lit(before) - F.col("t"))
    lacking_after = F.greatest(F.lit(0), F.col("t") + after + 1 - F.col("n"))
    window = F.concat(F.array_repeat(front, lacking_before), gathered(column, before, after), F.array_repeat(back, lacking_after))
    return steps.withColumn(out, window)


def chunk_neutral(steps: DataFrame, window: int, future: int, relative: Sequence[bool], goal: str | None = None) -> DataFrame:
    """Observation times t - window + 1 .. t floored at 0 with pad_mask, and actions up to t + future.

    Actions after the goal (the last step by default) are neutral: relative dims 0, absolute dims those of the goal step.
    A row holds the actions of its own window only; that of a goal before the window comes by a join.
    """
    frame = episode_window().rowsBetween(1 - window, future)
    all_actions = steps.withColumns({"__near": F.collect_list("action").over(frame), "__goal": F.col(goal) if goal else F.col("n") - 1, "__from": F.greatest(F.lit(0), F.col("t") - (window - 1))})
    if goal:
        at_goal = steps.select(*EPISODE, F.col("t").alias("__goal"), F.col("action").alias("__goal_action"))
        all_actions = all_actions.join(at_goal, [*EPISODE, "__goal"], "left")
    else:
        all_actions = all_actions.withColumn("__goal_action", F.lit(None).cast(steps.schema["action"].dataType))
    obs = F.sequence(F.col("t") - (window - 1), F.col("t"))
    acts = F.sequence(F.col("t") - (window - 1), F.col("t") + future)
    neutral = lambda a: F.zip_with(a, A.literal_mask(relative), lambda x, r: F.when(r, F.lit(0.0)).otherwise(x))
    place = lambda i: F.greatest(F.lit(0), F.least(i, F.col("__goal"))) - F.col("__from")
    at = lambda i: F.when(place(i) < 0, F.col("__goal_action")).otherwise(F.get(F.col("__near"), place(i)))
    made = all_actions.withColumns(
        {
            "obs_t": F.transform(obs, lambda i: F.greatest(F.lit(0), i)),
            "pad_mask": F.transform(obs, lambda i: i >= 0),
            "action_window": F.transform(acts, lambda i: F.when(i > F.col("__goal"), neutral(at(i))).otherwise(at(i))),
        }
    )
    return made.select(*steps.columns, "obs_t", "pad_mask", "action_window")


def chunk_truncate(steps: DataFrame, window: int, future: int) -> DataFrame:
    """The same without steps that lack `future` later ones, and without neutral actions."""
    first = whole_episode().orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lacking = F.greatest(F.lit(0), F.lit(window - 1) - F.col("t"))
    actions = F.concat(F.array_repeat(F.first("action").over(first), lacking), gathered("action", window - 1, future))
    return steps.withColumn("action_window", actions).where(F.col("t") < F.col("n") - future)


def lagged_pairs(steps: DataFrame, k: int, column: str = "action") -> DataFrame:
    """(s_t, s_{t+k}) where the episode is longer than k."""
    return steps.withColumn("later", F.lead(column, k).over(episode_window())).where(F.col("later").isNotNull())


def lagged_triplets(steps: DataFrame, k: int, column: str = "proprio") -> DataFrame:
    """(s_t, actions t .. t+k-1, s_{t+k})."""
    pairs = steps.withColumns({"later": F.lead(column, k).over(episode_window()), "actions": gathered("action", 0, k - 1)})
    return pairs.where(F.col("later").isNotNull())


def relabel_reached(steps: DataFrame, dims: int | None = None) -> DataFrame:
    """Actions become the change of state that was reached; the last dim is kept, the last step dropped."""
    nxt = F.lead("proprio").over(episode_window())
    change = F.zip_with(nxt, F.col("proprio"), lambda a, b: a - b)
    moved = F.slice(change, 1, dims) if dims else change
    return steps.withColumn("action", F.when(nxt.isNotNull(), moved)).where(F.col("action").isNotNull())


def binarize_gripper(steps: DataFrame, value: Column, out: str = "gripper") -> DataFrame:
    """Above 0.95 open (1), below 0.05 closed (0); between, what is decided next; a last undecided run keeps its last value."""
    decided = F.when(value > 0.95, 1.0).when(value < 0.05, 0.0)
    ahead = episode_window().rowsBetween(0, Window.unboundedFollowing)
    held = steps.withColumns({"__decided": decided, "__value": value})
    return held.withColumn(out, F.coalesce(F.first("__decided", ignorenulls=True).over(ahead), F.last("__value").over(ahead))).drop("__decided", "__value")


def relative_to_absolute_gripper(steps: DataFrame, value: Column, out: str = "gripper") -> DataFrame:
    """Opening and closing moves to a state: the last move's, before the first move its opposite, open if there is none."""
    move = F.when(value < -0.1, 1.0).when(value > 0.1, -1.0)
    behind = episode_window().rowsBetween(Window.unboundedPreceding, 0)
    ahead = episode_window().rowsBetween(0, Window.unboundedFollowing)
    held = steps.withColumn("__move", move)
    state = F.coalesce(F.last("__move", ignorenulls=True).over(behind), -F.first("__move", ignorenulls=True).over(ahead), F.lit(1.0))
    return held.withColumn(out, state / 2 + 0.5).drop("__move")


def uniform_goals(steps: DataFrame, key: Column, seed: int = 0) -> DataFrame:
    """goal_t drawn from t + 1 .. n - 1 (n - 1 on the last step), by the key."""
    left = F.greatest(F.col("n") - F.col("t") - 1, F.lit(1))
    goal = F.least(F.col("n") - 1, F.col("t") + 1 + F.floor(draw(key, seed) * left).cast("int"))
    return steps.withColumn("goal_t", goal)


def with_goal_columns(steps: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Copy the columns of the goal step: a join of an episode with itself on (episode, goal_t)."""
    goals = steps.select(*[F.col(c).alias(f"__{c}") for c in EPISODE], F.col("t").alias("__t"), *[F.col(c).alias(f"goal_{c}") for c in columns])
    on = [F.col(c) == F.col(f"__{c}") for c in EPISODE] + [F.col("goal_t") == F.col("__t")]
    return steps.join(goals, on).drop(*[f"__{c}" for c in EPISODE], "__t")


def task_dropout(steps: DataFrame, key: Column, keep_image: float, seed: int = 0) -> DataFrame:
    """Keep the goal image or the text of each row, never both; blank text keeps the image. Without the image goal_t is the last step."""
    image = (F.coalesce(F.col("language_instruction"), F.lit("")) == "") | (draw(key, seed) < keep_image)
    return steps.withColumns(
        {
            "keep_image": image,
            "language_instruction": F.when(image, F.lit("")).otherwise(F.col("language_instruction")),
            "goal_t": F.when(image, F.col("goal_t")).otherwise(F.col("n") - 1),
        }
    )


#: Strategies that a dataset's settings name.
GOAL_STRATEGIES = {"uniform": uniform_goals}
TASK_STRATEGIES = {"delete_task_conditioning": task_dropout}


def by_name(strategies: dict, name: str):
    """The strategy of a name; an unknown one is an error that tells those there are."""
    if name not in strategies:
        raise ValueError(f"no strategy {name}; there are {', '.join(sorted(strategies))}")
    return strategies[name]


def pad_mask_map(df: DataFrame, keys: Sequence[str], out: str = "pad_mask_dict") -> DataFrame:
    """key -> whether it holds anything: strings and bytes by length, all else true."""
    kinds = dict(df.dtypes)
    there = [F.coalesce(F.length(k) > 0, F.lit(False)) if kinds[k] in ("string", "binary") else F.lit(True) for k in keys]
    return df.withColumn(out, F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*there)))


def action_ensemble(steps: DataFrame, chunk: str, horizon: int, temperature: float) -> DataFrame:
    """For each step the weighted mean of what the last `horizon` plans foresaw for it, weight exp(-temperature * i), 0 the oldest.

    chunk: array<array<double>> planned at t for t, t + 1, ...
    """
    seen = steps.select(*EPISODE, "n", "t", F.posexplode(chunk).alias("i", "a")).where(f"i < {horizon}")
    aimed = seen.withColumn("target", F.col("t") + F.col("i")).where("target < n")
    ranked = aimed.withColumn("w", F.exp(-F.lit(float(temperature)) * (F.row_number().over(Window.partitionBy(*EPISODE, "target").orderBy("t")) - 1)))
    dims = ranked.select(*EPISODE, "target", "w", F.posexplode("a").alias("dim", "x"))
    return dims.groupBy(*EPISODE, F.col("target").alias("t"), "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))


def history_with_candidate(steps: DataFrame, candidate: Column, size: int, value: float = PAD) -> DataFrame:
    """The executed actions before t and a candidate for t, `size` in all, padded in front."""
    before = F.concat(F.collect_list("action").over(episode_window().rowsBetween(-(size - 1), -1)), F.array(candidate))
    return steps.withColumn("history", F.concat(F.array_repeat(F.array_repeat(F.lit(float(value)), F.size("action")), F.lit(size) - F.size(before)), before))


def recent_frames(steps: DataFrame, columns: Sequence[str], size: int, out: str = "frames") -> DataFrame:
    """The last `size` frames of each camera, interleaved; a short history repeats the latest frame."""
    def one(c: str) -> Column:
        got = gathered(c, size - 1, 0)
        return F.concat(got, F.array_repeat(F.col(c), F.lit(size) - F.size(got)))

    zipped = F.arrays_zip(*[one(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return steps.withColumn(out, F.flatten(F.transform(zipped, lambda z: F.array(*[z[f"c{i}"] for i in range(len(columns))]))))


def chunk_playback(steps: DataFrame, chunk: str, every: int) -> DataFrame:
    """The action that is executed at t when a plan is asked for every `every` steps and played step by step."""
    w = Window.partitionBy(*EPISODE, F.floor(F.col("t") / every)).orderBy("t")
    return steps.withColumn("played", F.get(F.first(chunk).over(w), F.col("t") % every))


def evenly_spaced(steps: DataFrame, picks: int) -> DataFrame:
    """`picks` steps of each episode, at truncated equal distances from the first to the last."""
    last = F.col("n") - 1
    wanted = F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda i: F.floor(i * last / float(max(picks - 1, 1))).cast("int"))
    return steps.where(F.array_contains(wanted, F.col("t")))


def drop_noops(steps: DataFrame, motion: Column, gripper: Column, threshold: float = 1e-4) -> DataFrame:
    """Without steps whose motion is below the threshold and whose gripper is that of the last kept step.

    Before the first real motion all still steps go; after it the last kept gripper is always the step before's.
    """
    marked = steps.withColumns({"__small": A.norm(motion) < threshold, "__g": gripper})
    first = F.min(F.when(~F.col("__small"), F.col("t"))).over(whole_episode())
    held = marked.withColumns({"__first": first, "__before": F.lag("__g").over(episode_window())})
    gone = F.col("__small") & (F.col("__first").isNull() | (F.col("t") < F.col("__first")) | (F.col("__g") == F.col("__before")))
    return held.where(~F.coalesce(gone, F.lit(False))).drop("__small", "__g", "__first", "__before")


def drop_first(steps: DataFrame) -> DataFrame:
    return renumbered(steps.where("t >= 1"))
