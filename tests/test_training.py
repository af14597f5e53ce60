"""From a mixture's name to rows in training order."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwright.operators import standardize, training


def raw(spark, episodes, shift):
    rows = [(e, t, 12, [float(10 * e + t + d) + shift for d in range(6)] + [float(t % 2)], [float(t)] * 8, "put it away") for e in range(episodes) for t in range(12)]
    return spark.createDataFrame(rows, "episode_id long, t int, n int, action array<double>, state array<double>, language_instruction string")


def test_named_mixtures_have_recipes_and_each_dataset_once():
    for name in training.MIXTURES:
        members = training.mixture_of(name)
        assert len(dict(members)) == len(members) and all(w > 0 for _, w in members)
        assert all(standardize.recipe_of(d) for d, _ in members)
    assert dict(training.mixture_of("rtx_franka"))["taco_play"] == 2.0  # the first weight counts
    assert training.mixture_of("libero_10_no_noops") == [("libero_10_no_noops", 1.0)]
    assert "language_table" not in dict(training.mixture_of("oxe_magic_soup_plus_minus"))
    with pytest.raises(KeyError):
        training.mixture_of("nothing of the kind")


def test_training_rows_are_normalized_weighted_and_in_order(spark):
    tables = {"libero_10_no_noops": raw(spark, 20, 0.0), "libero_goal_no_noops": raw(spark, 5, 1000.0)}
    mixture = [("libero_10_no_noops", 1.0), ("libero_goal_no_noops", 4.0), ("libero_10_no_noops", 9.0), ("libero_object_no_noops", 1.0)]
    out = sorted(training.training_rows(tables, mixture, 1200, seed=3).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in out] == list(range(1200))
    n = collections.Counter(r["dataset_name"] for r in out)
    assert set(n) == set(tables) and abs(n["libero_goal_no_noops"] - 600) < 60  # 4 * 60 steps against 1 * 240
    moves = np.array([r["action"][:6] for r in out])
    assert np.abs(moves).max() <= 1 and {r["action"][6] for r in out} <= {0.0, 1.0}
    for name in tables:
        own = moves[[r["dataset_name"] == name for r in out]]
        assert own.min() == -1 and own.max() == 1
    first = [r for r in out if r["dataset_name"] == "libero_goal_no_noops"][:60]
    assert len({(r["episode_id"], r["t"]) for r in first}) == 60 and {r["epoch"] for r in first} == {0}
    with pytest.raises(ValueError, match="no table"):
        training.training_rows(tables, "bridge", 5)


def test_actions_of_another_encoding_are_an_error(spark):
    steps = spark.createDataFrame([("a", 1, 0, [1.0] * 8, [0.0], "")], "dataset_name string, episode_id long, t int, action array<double>, proprio array<double>, language_instruction string")
    with pytest.raises(Exception, match="no actions of 8 dims"):
        training.normalized_steps(steps).collect()
