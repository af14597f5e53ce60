"""Steps whose work has to grow no faster than their input: slices of files, ranges of a dim."""

import re

from pyspark.sql import functions as F

from stepwright.operators import stats
from stepwright.sources import records
from stepwright.sources.storage import scratch
from stepwright.streaming import live


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slices_meet_rows_by_bins(spark):
    """Lengths around powers of 64, an empty slice, one that overlaps another, gaps, and equal indices in another file."""
    lengths = [1, 2, 63, 64, 65, 0, 4095, 4096, 4097, 3]
    slices, at = [], -130
    for i, n in enumerate(lengths):
        slices.append((i, 0, i % 2, at, at + n))
        at += n + i % 3
    slices += [(90, 0, 0, -10, 200), (91, 5, 0, 0, 10**15), (92, 7, 0, -130, at)]
    episodes = spark.createDataFrame(slices, "episode_index long, chunk_index int, file_index int, dataset_from_index long, dataset_to_index long")
    data = spark.range(-140, at + 10).select(F.explode(F.array(*[F.struct(F.lit(c).alias("chunk_index"), F.lit(f).alias("file_index")) for c, f in ((0, 0), (0, 1), (5, 0))])).alias("p"), F.col("id").alias("index")).select("p.*", "index")
    got = records.episode_frames(episodes, data, [0, 5])
    want = {(c, f, i, e) for e, c, f, a, b in slices if c in (0, 5) for i in range(max(a, -140), min(b, at + 10))}
    rows = [tuple(r) for r in got.select("chunk_index", "file_index", "index", "episode_index").collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert got.columns == ["chunk_index", "file_index", "index", "episode_index"]


def test_slices_of_one_file_are_not_compared_with_all_its_rows(spark):
    """30 000 episodes in one file would be 3.6e9 comparisons; the bins' equality has to be among the keys of the join."""
    episodes = spark.range(30_000).select(F.col("id").alias("episode_index"), F.lit(0).alias("chunk_index"), F.lit(0).alias("file_index"), (F.col("id") * 4).alias("dataset_from_index"), (F.col("id") * 4 + 4).alias("dataset_to_index"))
    data = spark.range(120_000).select(F.lit(0).alias("chunk_index"), F.lit(0).alias("file_index"), F.col("id").alias("index"))
    got = records.episode_frames(episodes, data)
    assert re.search(r"Join \[[^\]]*__bin", plan_of(got))
    assert got.where(F.col("episode_index") == F.floor(F.col("index") / 4)).count() == got.count() == 120_000


def test_ranges_are_sent_to_a_dims_values(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select(F.array(F.col("id").cast("double")).alias("v"))
        got = stats.histogram_quantiles(rows, "v", [0.5], 10)
        assert "BroadcastHashJoin" in plan_of(got) and "SortMergeJoin" not in plan_of(got)
        assert [tuple(r) for r in got.collect()] == [(0, 0.5, 399.6)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_episodes_of_a_lane_share_one_call(spark, tmp_path):
    """200 episodes in four lanes and three micro-batches; the calls, which each leave a line, must not grow with the episodes."""
    path, calls = scratch(spark), str(tmp_path / "calls")

    class Told(live.OrderedSteps):
        def __call__(self, key, frames, state):
            with open(calls, "a") as f:
                f.write("x\n")
            yield from super().__call__(key, frames, state)

    schema = "episode_id long, t int, ts timestamp, value array<double>"
    rows = spark.range(200 * 6).select(F.expr("id div 6").alias("episode_id"), F.expr("cast(5 - id % 6 as int)").alias("t"), F.timestamp_seconds(F.expr("1000 + id % 6")).alias("ts"), F.array(F.col("id").cast("double")).alias("value"))
    rows.repartition(3, "t", "episode_id").write.parquet(path)
    steps = Told(1, lambda held: held[0][1], 3_600_000)
    out = live._ordered(live.step_stream(spark, path, schema), steps, "episode_id long, t int, out array<double>", "1 hour", 4)
    got = live.drained_to_files(out, f"{path}-out", f"{path}-checkpoint").collect()
    assert sorted((r["episode_id"], r["t"], r["out"][0]) for r in got) == [(e, t, e * 6 + 5.0 - t) for e in range(200) for t in range(6)]
    with open(calls) as f:
        assert len(f.readlines()) <= 4 * 5


def test_frames_that_wait_for_their_trajectory_are_packed():
    """500 scored frames of trajectories that are not whole are one value of state; they go out when the lane is drained."""
    import pandas as pd

    class State:
        rows = None
        exists = lambda self: self.rows is not None
        get = lambda self: self.rows

        def put(self, rows):
            self.rows = rows

        update = put

        def clear(self):
            self.rows = None

    class Handle:
        def __init__(self):
            self.states = {}

        def getListState(self, name, schema):
            return self.states.setdefault(name, State())

        getValueState = getListState
        registerTimer = deleteTimer = lambda self, ms: None

    handle, batches = Handle(), live.Batches(50, lambda m: m[:, 0], 1000)
    batches.init(handle)
    frame = pd.DataFrame({"episode_id": [i % 5 for i in range(510)], "t": [i // 5 for i in range(510)], "n": 200, "value": [pd.array([float(i)]).to_numpy() for i in range(510)], "ts": pd.Timestamp("2020-01-01")})
    assert sum(len(x) for x in batches.handleInputRows((0,), iter([frame]), None)) == 0
    assert len(handle.states["done"].rows) == 1 and len(handle.states["waiting"].rows) == 10
    (out,) = batches.handleExpiredTimer((0,), None, None)
    assert sorted(out["score"]) == [float(i) for i in range(510)] and sorted(out["batch_rows"].unique()) == [10, 50]
