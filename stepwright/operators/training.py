"""From the name of a mixture to the rows a policy is trained on: standardized, normalized, weighted, in order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..sources.storage import scratch, written
from .mixture import interleaved
from .standardize import standardize, recipe_of
from .stats import dataset_statistics, statistics_arrays

_CONVERTED = "_converted_externally_to_rlds"
_RTX = [
    ("fractal20220817_data", 0.54087122203), ("kuka", 0.8341046294), ("bridge_orig", 1.0), ("taco_play", 2.0), ("jaco_play", 2.0),
    ("berkeley_cable_routing", 3.0), ("roboturk", 1.0), ("viola", 2.0), ("berkeley_autolab_ur5", 1.0), ("toto", 1.0),
]
_SOUP = [
    ("fractal20220817_data", 0.54087122203), ("kuka", 0.8341046294), ("bridge_orig", 1.0), ("taco_play", 2.0), ("jaco_play", 1.0),
    ("berkeley_cable_routing", 1.0), ("roboturk", 2.0), ("viola", 2.0), ("berkeley_autolab_ur5", 2.0), ("toto", 1.0), ("language_table", 0.1),
    (f"stanford_hydra_dataset{_CONVERTED}", 2.0), (f"austin_buds_dataset{_CONVERTED}", 1.0), (f"nyu_franka_play_dataset{_CONVERTED}", 3.0),
    (f"furniture_bench_dataset{_CONVERTED}", 0.1), (f"ucsd_kitchen_dataset{_CONVERTED}", 2.0), (f"austin_sailor_dataset{_CONVERTED}", 1.0),
    (f"austin_sirius_dataset{_CONVERTED}", 1.0), (f"dlr_edan_shared_control{_CONVERTED}", 1.0), (f"iamlab_cmu_pickup_insert{_CONVERTED}", 1.0),
    ("utaustin_mutex", 1.0), ("berkeley_fanuc_manipulation", 2.0), ("cmu_stretch", 1.0),
]
_MORE = [("bc_z", 0.2), ("fmb_dataset", 1.0), ("dobbe", 0.2)]
_FRANKA = [
    ("taco_play", 1.0), ("berkeley_cable_routing", 1.0), ("viola", 1.0), ("toto", 1.0), (f"stanford_hydra_dataset{_CONVERTED}", 1.0),
    (f"austin_buds_dataset{_CONVERTED}", 3.0), (f"nyu_franka_play_dataset{_CONVERTED}", 3.0), (f"maniskill_dataset{_CONVERTED}", 0.1),
    (f"furniture_bench_dataset{_CONVERTED}", 0.1), (f"cmu_franka_exploration_dataset{_CONVERTED}", 5.0), (f"austin_sailor_dataset{_CONVERTED}", 1.0),
    (f"austin_sirius_dataset{_CONVERTED}", 1.0), (f"berkeley_rpt{_CONVERTED}", 1.0), (f"kaist_nonprehensile{_CONVERTED}", 3.0),
    (f"stanford_robocook{_CONVERTED}", 1.0), (f"iamlab_cmu_pickup_insert{_CONVERTED}", 1.0), ("utaustin_mutex", 1.0), ("cmu_play_fusion", 1.0),
]
#: Datasets and weights of published mixtures. Any dataset alone is a mixture of its own name.
MIXTURES: dict[str, list[tuple[str, float]]] = {
    "bridge": [("bridge_orig", 1.0)],
    "bridge_rt_1": [("bridge_orig", 1.0), ("fractal20220817_data", 1.0)],
    "rtx": _RTX,
    "rtx_franka": _RTX + _FRANKA,
    "oxe_magic_soup": _SOUP,
    "oxe_magic_soup_plus": [*_SOUP, *_MORE, ("droid", 0.06)],
    "oxe_magic_soup_plus_minus": [("fractal20220817_data", 1.0), *[x for x in _SOUP[1:] if x[0] != "language_table"], *_MORE],
}

#: Dims of the two action encodings that are trained on: moves of the end effector by Euler angles or by six numbers, then the gripper.
ENCODINGS = (7, 10)


def mixture_of(name: str) -> list[tuple[str, float]]:
    """The datasets and weights of a mixture, each dataset once, by its first weight."""
    out: dict[str, float] = {}
    for dataset, weight in MIXTURES.get(name, [(name, 1.0)]):
        recipe_of(dataset)  # an unknown one is an error
        out.setdefault(dataset, weight)
    return list(out.items())


def normalized_steps(steps: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """Standard steps with actions and states in [-1, 1] by their dataset's 1 % and 99 % bounds; the gripper, the last action dim, as it is.

    An action of another encoding is an error when the row is read. Without statistics they are computed from the steps.
    """
    statistics = dataset_statistics(steps) if statistics is None else statistics
    arrays = [statistics_arrays(statistics, f, ("q01", "q99")).select("dataset_name", F.col("q01").alias(f"__{f}_lo"), F.col("q99").alias(f"__{f}_hi")) for f in ("action", "proprio")]
    known = steps.join(arrays[0], "dataset_name").join(arrays[1], "dataset_name")  # a row for each dataset
    size = F.size("action")
    checked = F.when(size.isin(*ENCODINGS), F.col("action")).otherwise(F.raise_error(F.concat(F.col("dataset_name"), F.lit(": no actions of "), size.cast("string"), F.lit(" dims"))))
    moves = F.transform(F.sequence(F.lit(1), size), lambda i: i < size)
    every = F.transform("proprio", lambda _: F.lit(True))
    action = normalize.to_bounds(checked, F.col("__action_lo"), F.col("__action_hi"), moves)
    # to_bounds gives 0 for a constant dim even where it is masked; a gripper that never moves stays as it is
    whole = F.concat(F.slice(action, F.lit(1), size - 1), F.slice("action", -1, 1))
    return known.withColumns({"action": whole, "proprio": normalize.to_bounds(F.col("proprio"), F.col("__proprio_lo"), F.col("__proprio_hi"), every)}).select(*steps.columns)


def training_rows(tables: Mapping[str, DataFrame], mixture: str | Sequence[tuple[str, float]], total: int, balance: bool = True, seed: int = 0) -> DataFrame:
    """`total` rows of a mixture in training order: position, epoch, dataset_name, episode_id, t, action, proprio, language_instruction.

    tables: raw steps by dataset (episode_id, t, n and the columns of the dataset's recipe); datasets of the mixture without a
    table are left out. With `balance` a weight counts by its dataset's steps. Everything but the order is a projection over joins with a
    row for each dataset; the standardized steps are written once, and read for the statistics and for the rows.
    """
    members = mixture_of(mixture) if isinstance(mixture, str) else list(dict(reversed(list(mixture))).items())[::-1]
    there = [(name, weight) for name, weight in members if name in tables]
    if not there:
        raise ValueError("no table for any dataset of the mixture")
    columns = ["dataset_name", "episode_id", "t", "action", "proprio", "language_instruction"]
    each = [standardize(tables[name].withColumn("dataset_name", F.lit(name)), name).select(*columns) for name, _ in there]
    steps = written(reduce(DataFrame.unionByName, each), scratch(each[0].sparkSession))
    rows = normalized_steps(steps)
    if balance:
        sizes = {r["dataset_name"]: r["n"] for r in steps.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n")).collect()}  # of the given tables
        there = [(name, weight * sizes.get(name, 0)) for name, weight in there]
    key = F.xxhash64("episode_id", "t")
    return interleaved(rows, there, total, key, ["episode_id", "t"], seed)
