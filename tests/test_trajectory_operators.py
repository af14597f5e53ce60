"""Small cases worked out by hand: short episodes, grippers, still steps, bounds, text keys, ties, ranges."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwright.functions import arrays as A
from stepwright.functions import rotations
from stepwright.functions import keyed, tokens
from stepwright.functions import normalize as N
from stepwright.functions import text as X
from stepwright.operators import filters, metrics, mixture, retrieval, stages, standardize, stats, verifier
from stepwright.operators import windows as W
from stepwright.sources import records


def steps(spark, *episodes, text="go"):
    rows = [("d", e, t, len(actions), list(map(float, a)), [float(t)], text) for e, actions in enumerate(episodes) for t, a in enumerate(actions)]
    return spark.createDataFrame(rows, "dataset_name string, episode_id long, t int, n int, action array<double>, proprio array<double>, language_instruction string")


def by_step(df, column):
    return {(r["episode_id"], r["t"]): r[column] for r in df.collect()}


def test_padded_window_of_short_and_exact_episodes(spark):
    df = steps(spark, [[1]], [[1], [2], [3]])
    got = by_step(W.padded_window(df, 1, 1), "action_window")
    assert got[0, 0] == [[-5.0], [1.0], [-5.0]]
    assert got[1, 1] == [[1.0], [2.0], [3.0]]
    assert got[1, 2] == [[2.0], [3.0], [-5.0]]
    edge = by_step(W.padded_window(df, 2, 2, pad="edge"), "action_window")
    assert edge[0, 0] == [[1.0]] * 5
    assert edge[1, 0] == [[1.0], [1.0], [1.0], [2.0], [3.0]]


def test_window_width_is_constant_and_repartitioning_changes_nothing(spark):
    df = steps(spark, *[[[i] for i in range(n)] for n in range(1, 9)])
    w = W.padded_window(df, 3, 2)
    assert {len(r["action_window"]) for r in w.collect()} == {6}
    assert sorted(map(str, W.padded_window(df.repartition(3), 3, 2).collect())) == sorted(map(str, w.collect()))


def test_neutral_chunk_after_goal(spark):
    df = steps(spark, [[1, 10], [2, 20]])
    got = by_step(W.chunk_neutral(df, 2, 2, [True, False]), "action_window")
    assert got[0, 0] == [[1, 10], [1, 10], [2, 20], [0, 20]]
    assert by_step(W.chunk_neutral(df, 2, 2, [True, False]), "pad_mask")[0, 0] == [False, True]


@pytest.mark.parametrize("raw, want", [([0.5, 0.5, 1.0], [1, 1, 1]), ([0.0, 0.5, 0.6], [0, 0.6, 0.6]), ([0.5, 0.4], [0.4, 0.4])])
def test_binarize_gripper(spark, raw, want):
    got = by_step(W.binarize_gripper(steps(spark, [[x] for x in raw]), F.col("action")[0]), "gripper")
    assert [got[0, t] for t in range(len(raw))] == want


@pytest.mark.parametrize("raw, want", [([0, 1, 0, -1], [1, 0, 0, 1]), ([0, 0], [1, 1]), ([0, -1, 0], [0, 1, 1])])
def test_relative_gripper(spark, raw, want):
    got = by_step(W.relative_to_absolute_gripper(steps(spark, [[x] for x in raw]), F.col("action")[0]), "gripper")
    assert [got[0, t] for t in range(len(raw))] == want


def loop_noops(actions, threshold):
    kept, last = [], None
    for t, (m, g) in enumerate(actions):
        small = abs(m) < threshold
        if not (small and (last is None or g == last)):
            kept.append(t)
            last = g
    return kept


def test_drop_noops_equals_the_loop(spark):
    r = np.random.default_rng(0)
    episodes = [[(float(r.integers(0, 2)), float(r.integers(0, 2))) for _ in range(r.integers(1, 8))] for _ in range(200)]
    df = W.drop_noops(steps(spark, *episodes), F.slice("action", 1, 1), F.col("action")[1], 0.5)
    got = {}
    for row in df.collect():
        got.setdefault(row["episode_id"], []).append(row["t"])
    assert {e: sorted(v) for e, v in got.items()} == {e: k for e, a in enumerate(episodes) if (k := loop_noops(a, 0.5))}


def test_bounds_with_constant_and_masked_dims(spark):
    row = spark.range(1).select(
        N.to_bounds(A.vector([5, 7, 3]), A.vector([0, 7, 3]), A.vector([10, 7, 3]), A.literal_mask([True, True, False])).alias("y"),
        N.proprio_bounds(A.vector([5]), A.vector([0]), A.vector([1]), A.literal_mask([False])).alias("p"),
    ).first()
    assert row["y"] == pytest.approx([0, 0, 0], abs=1e-8)
    assert row["p"] == [1.0]


def test_quantiles_invert(spark):
    lo, hi, m = A.vector([-1, 2]), A.vector([3, 9]), A.literal_mask([True, True])
    x = A.vector([0.5, 4.0])
    assert spark.range(1).select(N.from_quantiles(N.to_quantiles(x, lo, hi, m), lo, hi, m).alias("x")).first()["x"] == pytest.approx([0.5, 4.0])


def test_delta_and_absolute_actions(spark):
    chunk = F.array(A.vector([3, 4, 5]), A.vector([5, 6, 7]))
    state, mask = A.vector([1, 2, 3]), A.literal_mask([False, True])
    padded = F.concat(mask, F.array(F.lit(False)))
    row = spark.range(1).select(N.shifted(chunk, state, padded, -1).alias("d"), N.shifted(N.shifted(chunk, state, padded, -1), state, padded, 1).alias("a")).first()
    assert row["d"] == [[3, 2, 5], [5, 4, 7]]
    assert row["a"] == [[3, 4, 5], [5, 6, 7]]


def test_bool_mask():
    assert A.bool_mask(2, -1, 2) == [True, True, False, True, True]
    assert A.bool_mask(2, 0, 2) == [True] * 4


def test_digitize_matches_numpy_at_edges(spark):
    e = np.array(tokens.edges(256))
    values = [*e.tolist(), *np.nextafter(e, -2).tolist(), *np.nextafter(e, 2).tolist(), -3.0, 3.0]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r["b"] for r in df.select(tokens.bin_of(F.col("x"), 256).alias("b")).collect()]
    assert got == np.digitize(np.clip(values, -1, 1), e).tolist()


def test_text_keys(spark):
    rows = [("  Pick up!?. ",), ("???",), ("   ",), ("",), ("Öffne die Tür.",), ("open demo",), ("a_b  c",)]
    df = spark.createDataFrame(rows, "s string")
    got = [tuple(r) for r in df.select(X.key_a(F.col("s")), X.key_b(F.col("s")), X.key_c(F.col("s")), X.key_d(F.col("s"))).collect()]
    assert got[0] == ("pick up", "pick up", "pick up", "Pick up!?.")
    assert got[1] == (None, "", None, "???")
    assert got[2] == (None, "", None, None) and got[3] == (None, "", None, None)
    assert got[4][1] == "öffne die tür"
    assert got[5][2] == "open"
    assert got[6][1] == "a_b c"


def test_keep_ranges_are_half_open_and_may_touch_or_overlap(spark):
    frames = spark.createDataFrame([("a", t) for t in range(8)] + [("b", 0)], "episode_key string, t int")
    ranges = spark.createDataFrame([("a", 1, 3), ("a", 3, 4), ("a", 2, 5), ("a", 6, 6)], "episode_key string, start int, end int")
    assert sorted(r["t"] for r in filters.keep_ranges(frames, ranges).collect()) == [1, 2, 3, 4]
    assert filters.keep_ranges(frames, None).count() == 9


def test_success_paths_keep_the_original_rule(spark):
    df = spark.createDataFrame([("x/success/1",), ("x/unsuccessful/2",), ("x/failure",)], "p string")
    assert filters.successful_path(df, "p").count() == 2


def test_statistics_of_batches(spark):
    rows = [("d", 0, i, 4, [float(3 * i + j) for j in range(3)], [0.0], "") for i in range(4)]
    df = spark.createDataFrame(rows, "dataset_name string, episode_id long, t int, n int, action array<double>, proprio array<double>, language_instruction string")
    x = np.arange(12).reshape(4, 3)
    got = {r["dim"]: r for r in stats.running_statistics(df, "action").collect()}
    assert [got[d]["mean"] for d in range(3)] == pytest.approx(x.mean(0).tolist())
    assert [got[d]["std"] for d in range(3)] == pytest.approx(x.std(0).tolist())
    assert stats.running_statistics(df.limit(1), "action").count() == 0
    exact = {r["dim"]: r for r in stats.dataset_statistics(df, ["action"]).collect()}
    assert exact[0]["q99"] == pytest.approx(np.quantile(x[:, 0], 0.99))


def test_unknown_dataset_is_an_error(spark):
    df = steps(spark, [[1]])
    other = spark.createDataFrame([("e", [0.0])], "dataset_name string, mean array<double>")
    assert [r[0] for r in stats.unknown_datasets(df, other).collect()] == ["d"]
    with pytest.raises(Exception, match="no statistics for dataset d"):
        stats.require_known(df, other).collect()


def test_statistics_cache_and_missing_file(spark, tmp_path):
    df = steps(spark, [[1], [2]])
    a = stats.cached_statistics(df, str(tmp_path), "d", {"x": 1}).count()
    assert a == stats.cached_statistics(df.limit(0), str(tmp_path), "d", {"x": 1}).count() > 0
    with pytest.raises(Exception):
        stats.load_statistics(spark, str(tmp_path / "none")).count()


def test_windows_with_negative_zero_are_one(spark):
    df = spark.createDataFrame([([[0.0]],), ([[-0.0]],), ([[1.0]],)], "w array<array<double>>")
    assert df.select(verifier.window_id("w").alias("i")).distinct().count() == 2


def test_fanout_counts(spark):
    samples = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "instruction string, t int")
    r = spark.createDataFrame([("a", 0, "x"), ("a", 1, "b"), ("b", 0, "y")], "original string, pos int, rephrase string")
    assert verifier.rephrase_fanout(samples, r).count() == 3 + 2 * 2 + 1
    assert sorted(x["rephrase"] for x in verifier.new_instruction_keys(r).collect()) == ["x", "y"]


def test_apportioned_sums_and_minimum(spark):
    shares = spark.createDataFrame([("a", 0.96), ("b", 0.03), ("c", 0.01)], "dataset_name string, share double")
    got = {r["dataset_name"]: r["quota"] for r in mixture.apportioned(shares, 10, "dataset_name").collect()}
    assert sum(got.values()) == 10 and min(got.values()) == 1


def test_mixture_repeats_small_datasets(spark):
    rows = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(10)], "dataset_name string, k long")
    quotas = spark.createDataFrame([("a", 7), ("b", 4)], "dataset_name string, quota long")
    got = mixture.mixture_sample(rows, quotas, F.col("k"), ["k"]).groupBy("dataset_name").count()
    assert {r[0]: r[1] for r in got.collect()} == {"a": 7, "b": 4}


def test_effective_length_needs_a_weight_of_one(spark):
    m = spark.createDataFrame([("a", 2.0, 10), ("b", 0.5, 10)], "dataset_name string, weight double, n long")
    assert mixture.effective_length(m).first()[0] is None


def test_ranks_by_draw_are_dense(spark):
    df = spark.range(500).select("id")
    got = sorted(r["rank"] for r in keyed.ranked(df, keyed.draw(F.col("id"), 3), ["id"]).collect())
    assert got == list(range(1, 501))


def test_best_of_n_takes_the_first_of_equals(spark):
    c = spark.createDataFrame([("g", 1, 0.5), ("g", 0, 0.5), ("g", 2, 0.1)], "g string, i int, s double")
    assert mixture.best_of_n(c, ["g"], "s", "i").first()["i"] == 0


def test_pearson_and_pass_at_k(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.4, 0.5), (0.2, 0.3)], "x double, y double")
    assert metrics.pearson(df, "x", "y").first()[0] == 1.0
    s = spark.createDataFrame([("t", i < 2) for i in range(5)], "task string, passed boolean")
    got = {r["k"]: r["pass_at_k"] for r in metrics.pass_at_k(s, "task", "passed", [1, 2, 9]).collect()}
    assert got[1] == pytest.approx(0.4) and got[2] == pytest.approx(1 - math.comb(3, 2) / math.comb(5, 2)) and 9 not in got


def test_top_k_larger_than_the_batch_is_null(spark):
    s = spark.createDataFrame([(0, i, j, float(i == j)) for i in range(2) for j in range(2)], "batch int, i int, j int, score double")
    row = retrieval.top_k_both_ways(s, "batch", [1, 5]).first()
    assert row["rows_top_1"] == 1.0 and row["rows_top_5"] is None


def test_triangle_area_of_a_right_angle(spark):
    row = spark.range(1).select(retrieval.triangle_area(A.vector([0, 0]), A.vector([3, 0]), A.vector([0, 4])).alias("a")).first()
    assert row["a"] == pytest.approx(6.0)


def test_renames_and_their_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a_1 int, a_2 int")
    assert standardize.renamed(df, [(r"a_(\d)", r"b/\1")]).columns == ["b/1", "b/2"]
    with pytest.raises(ValueError):
        standardize.renamed(df, [(r"a_.", "c")])
    with pytest.raises(ValueError):
        standardize.renamed(df, [(r"a_1", "c"), (r"a_2", "c/d")])


def test_missing_view_is_an_error(spark):
    with pytest.raises(ValueError):
        standardize.restructure(steps(spark, [[1]]), "d", {"primary": "cam"}, ["proprio"], None)


def test_missing_task_is_an_error(spark):
    rows, tasks = spark.createDataFrame([(3,)], "task_index long"), spark.createDataFrame([(1, "x")], "task_index long, task string")
    with pytest.raises(Exception, match="no task 3"):
        records.prompt_from_task(rows, tasks).collect()


def test_chunk_filter():
    assert records.chunk_filter("0, 2") == [0, 2] and records.chunk_filter(" ") is None


def test_rephrase_map_drops_blanks(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"1": {"original": "go", "rephrases": ["a", " ", "b"]}, "2": {"original": " ", "rephrases": ["c"]}}')
    got = records.rephrases_of_map(spark, str(tmp_path / "m.json")).orderBy("pos").collect()
    assert [(r["id"], r["pos"], r["rephrase"]) for r in got] == [("1", 0, "a"), ("1", 1, "b")]


@pytest.mark.parametrize("size, inner", [((4, 8), (3, 6)), ((9, 3), (6, 2)), ((6, 6), (6, 6))])
def test_resize_with_pad(size, inner):
    out = stages.resize_with_pad(np.full((*size, 3), 200, np.uint8), 6, 6)
    assert out.shape == (6, 6, 3)
    assert int((out[:, :, 0] == 200).sum()) == inner[0] * inner[1]


def test_wrist_frame_without_rotation_changes_nothing(spark):
    row = spark.range(1).select(rotations.wrist_frame(A.vector([1, 2, 3, 0, 0, 0]), A.vector([0] * 6)).alias("m")).first()
    assert row["m"] == pytest.approx([1, 2, 3, 1, 0, 0, 0, 1, 0])


def test_all_recipes_have_a_known_shape():
    assert len(standardize.RECIPES) == 62 and all(r in standardize.RECIPES for r in standardize.ALIASES.values())
    assert all(p.how in ("", "clip", "invert", "invert_clip", "binarize", "absolute", "euler", "zeros", "ones") for r in standardize.RECIPES.values() for p in (*r.action, *r.proprio))


def png(image, kinds):
    """A PNG file whose rows have the given filters."""
    h, w, c = image.shape
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    x = np.zeros((h + 1, w + 1, c), int)
    x[1:, 1:] = image
    rows = []
    for y in range(1, h + 1):
        now, up, left, corner = x[y, 1:], x[y - 1, 1:], x[y, :-1], x[y - 1, :-1]
        p = left + up - corner
        d = [abs(p - left), abs(p - up), abs(p - corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        kind = kinds[y % len(kinds)]
        guess = {0: 0 * now, 1: left, 2: up, 3: (left + up) // 2, 4: paeth}[kind]
        rows.append(bytes([kind]) + ((now - guess) % 256).astype(np.uint8).tobytes())
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0])
    body = zlib.compress(b"".join(rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body[:50]) + chunk(b"IDAT", body[50:]) + chunk(b"IEND", b"")


def test_encoded_images(spark):
    r = np.random.default_rng(3)
    for channels in (1, 2, 3, 4):
        image = r.integers(0, 256, (9, 7, channels)).astype(np.uint8)
        assert (stages.png_pixels(png(image, [0, 1, 2, 3, 4])) == image).all()
    image = r.integers(0, 256, (8, 8, 3)).astype(np.uint8)
    rows = spark.createDataFrame([(1, 8, 8, bytearray(image.tobytes())), (2, None, None, bytearray(png(image, [4, 3]))), (3, None, None, None)], "id int, height int, width int, data binary")
    got = {x["id"]: bytes(x["pixels"]) for x in stages.prepared_images(rows, ["id"], 8, 8).collect()}
    assert got[1] == got[2] == image.tobytes() and got[3] == bytes(192)
    both = stages.side_by_side(spark.createDataFrame([(bytearray(image.tobytes()), bytearray(image[:, :2].tobytes()))], "a binary, b binary"), ["a", "b"], 8, "both").first()["both"]
    assert bytes(both) == np.concatenate([image, image[:, :2]], axis=1).tobytes()


def test_strategies_by_name():
    assert W.by_name(W.GOAL_STRATEGIES, "uniform") is W.uniform_goals
    with pytest.raises(ValueError, match="uniform"):
        W.by_name(W.GOAL_STRATEGIES, "last")


def test_unnamed_split_without_fallback(spark):
    with pytest.raises(ValueError):
        mixture.split_episodes(steps(spark, [[1]]), F.col("episode_id"), fallback=False)
