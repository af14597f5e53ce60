"""Streams of steps: late and repeated steps, gaps, state that goes, restarts, batches over micro-batches, counters that are run again."""

import collections

import pytest
from pyspark.sql import functions as F

from stepwright.sources.storage import scratch
from stepwright.streaming import live

STEPS = "episode_id long, t int, n int, ts timestamp, value array<double>"


def arrive(spark, path, rows):
    """One more file: (episode, t, n, seconds); the value is t + 100 * episode."""
    made = [(e, t, n, 10_000.0 + s, [t + 100.0 * (e or 0), 1.0]) for e, t, n, s in rows]
    df = spark.createDataFrame(made, "episode_id long, t int, n int, s double, value array<double>")
    df.select("episode_id", "t", "n", F.timestamp_seconds("s").alias("ts"), "value").coalesce(1).write.mode("append").parquet(path)


def history(spark, path, idle_ms=3_600_000):
    stream = live.step_stream(spark, path, STEPS)
    rows = live.drained_to_files(live.live_history(stream, 3, "100 seconds", idle_ms), f"{path}-out", f"{path}-checkpoint").collect()
    return sorted((r["episode_id"], r["t"], [a[0] for a in r["out"]]) for r in rows)


def expected(episode, ts, size=3):
    """Rows of an episode whose steps `ts` went out in order."""
    v = [t + 100.0 * episode for t in ts]
    return [(episode, t, ([live.PAD] * size + v[: i + 1])[-size:]) for i, t in enumerate(ts)]


def test_shuffled_and_repeated_steps_give_the_ordered_rows(spark):
    path = scratch(spark)
    arrive(spark, path, [(1, 3, 5, 3), (1, 0, 5, 0), (2, 1, 3, 1)])
    arrive(spark, path, [(1, 2, 5, 2), (2, 2, 3, 2), (1, 0, 5, 0)])
    assert history(spark, path) == expected(1, [0])  # all others wait for the steps before them
    arrive(spark, path, [(1, 1, 5, 1), (1, 4, 5, 4), (2, 0, 3, 0), (1, 3, 5, 3)])
    # the same checkpoint: what has gone out is not sent again, what waited is still there
    assert history(spark, path) == expected(1, [0, 1, 2, 3, 4]) + expected(2, [0, 1, 2])


def test_a_gap_is_given_up_once_the_watermark_is_past_it(spark):
    path = scratch(spark)
    arrive(spark, path, [(1, 0, 9, 1000), (1, 2, 9, 1002), (1, 3, 9, 1003)])
    assert history(spark, path) == expected(1, [0])
    arrive(spark, path, [(2, 0, 1, 1200)])  # watermark 1100
    assert history(spark, path) == expected(1, [0, 2, 3]) + expected(2, [0])
    arrive(spark, path, [(1, 1, 9, 1001), (1, 4, 9, 1150)])  # step 1 is too late
    assert history(spark, path) == expected(1, [0, 2, 3, 4]) + expected(2, [0])


def test_state_of_a_finished_episode_goes(spark):
    path = scratch(spark)
    arrive(spark, path, [(1, 0, 1, 1000)])
    history(spark, path, 50_000)
    arrive(spark, path, [(2, 0, 1, 2000)])
    arrive(spark, path, [(None, 0, 0, 9000)])
    stream = live.live_history(live.step_stream(spark, path, STEPS), 3, "100 seconds", 50_000)
    with live.keyed_state(spark):
        q = stream.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_ensemble_of_late_plans(spark):
    path = scratch(spark)
    plan = "episode_id long, t int, ts timestamp, value array<array<double>>"
    for ts in ([2, 0], [1, 3]):
        rows = [(7, t, 1.0 + t, [[10.0 * t + i] for i in range(2)]) for t in ts]
        spark.createDataFrame(rows, "episode_id long, t int, s double, value array<array<double>>").select("episode_id", "t", F.timestamp_seconds("s").alias("ts"), "value").coalesce(1).write.mode("append").parquet(path)
    out = live.live_ensemble(live.step_stream(spark, path, plan), 2, 0.0)
    rows = live.drained_to_files(out, f"{path}-out", f"{path}-checkpoint").collect()
    assert sorted((r["t"], r["out"][0]) for r in rows) == [(0, 0.0), (1, 5.5), (2, 15.5), (3, 25.5)]


def test_full_batches_have_the_size_over_micro_batches(spark):
    path = scratch(spark)
    seen = []
    frames = [(e, t, 5, 5 * e + t) for e in range(8) for t in range(5)]
    for part in range(4):
        arrive(spark, path, frames[part::4])
    arrive(spark, path, [(None, 0, 0, 100_000)])
    for _ in range(2):  # the second run finds nothing new
        stream = live.model_batches(live.step_stream(spark, path, STEPS), lambda m: m[:, 0], 7, 2, "1000 seconds", 1000)
        seen = live.drained_to_files(stream, f"{path}-out", f"{path}-checkpoint").collect()
    assert sorted((r["episode_id"], r["t"], r["score"]) for r in seen) == sorted((e, t, t + 100.0 * e) for e, t, _, _ in frames)
    sizes = collections.Counter((r["lane"], r["batch"]) for r in seen)
    assert all(n == 7 for (lane, batch), n in sizes.items() if (lane, batch + 1) in sizes)
    assert all(r["batch_rows"] == sizes[r["lane"], r["batch"]] for r in seen)
    assert len({r["lane"] for r in seen}) == 2 and max(sizes.values()) == 7


def test_counts_stay_right_when_a_batch_runs_again(spark):
    path = scratch(spark)
    ends = lambda *rows: spark.createDataFrame(rows, "task string, success boolean")
    counts = lambda: sorted(map(tuple, live.counts_in(spark, path).collect()))
    live.merge_counts(ends(("a", True), ("a", False), ("b", True)), 0, path)
    for _ in range(2):
        live.merge_counts(ends(("a", True), ("c", False)), 1, path)
        assert counts() == [("a", 3, 2), ("b", 1, 1), ("c", 1, 0)]
    live.merge_counts(ends(("b", None)).where("false"), 2, path)
    assert counts() == [("a", 3, 2), ("b", 1, 1), ("c", 1, 0)]


def test_counts_of_a_stream_that_dies_between_write_and_commit(spark, monkeypatch):
    path, counts = scratch(spark), scratch(spark)
    for k in range(3):
        spark.createDataFrame([("a", True, k == 1), ("b", False, True)], "task string, done boolean, success boolean").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: live.step_stream(spark, path, "task string, done boolean, success boolean")
    whole, died = live.merge_counts, []

    def dies(frame, batch, to):
        whole(frame, batch, to)
        if batch == 1 and not died:
            died.append(batch)
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(live, "merge_counts", dies)
    with pytest.raises(Exception, match="lost after the write"):
        live.count_episodes(stream(), counts, f"{path}-checkpoint")
    live.count_episodes(stream(), counts, f"{path}-checkpoint")
    assert died and [tuple(r) for r in live.counts_in(spark, counts).collect()] == [("a", 3, 1)]


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(live._STORE, None)
    with live.keyed_state(spark):
        assert spark.conf.get(live._STORE) == live._ROCKS
    assert spark.conf.get(live._STORE, None) == before
