"""Live episodes over a stream of steps that may come late and in any order: action history, ensembles, model batches, counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PAD = -5.0
LANES = 1024  # of ordered steps; a lane has to fit a Python worker
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of step files, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started meanwhile keep their state in RocksDB, which state of several variables needs; then the session is as before."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def _millis(ts) -> int:
    return int(ts.value // 1_000_000)


class OrderedSteps:
    """Per episode: steps go out in order of t, each with what `of_held` makes of the last `size` steps.

    A step goes out as soon as all steps before it are there, so steps that come in order never wait. Behind a gap steps wait until it
    is filled, or until the watermark is past their own time: then the missing ones are given up, and those that come later yet are
    dropped, as are repeated ones (the first counts). When the watermark is `idle` past an episode's last step, its state goes.

    Episodes share lanes, whose rows and state come and go as a whole, so that no episode costs a call or a round trip of its own.
    State of a lane: episode -> [t of the next step, last step's time, the last `size` steps that went out, steps behind a gap].
    """

    def __init__(self, size: int, of_held: Callable[[list], list], idle_ms: int) -> None:
        self.size, self.of_held, self.idle_ms = size, of_held, idle_ms

    def __call__(self, key, frames, state) -> Iterator:
        import pickle

        import pandas as pd

        lane: dict[int, list] = pickle.loads(state.get[0]) if state.exists else {}
        for frame in frames:
            for known, episode, t, ms, value in zip(*(frame[c].tolist() for c in ("__known", "__episode", "t", "__ms", "value"))):
                if not known:  # rows without an episode only move the clock
                    continue
                place = lane.get(episode)
                if place is None:
                    place = lane[episode] = [0, 0, [], {}]
                if t >= place[0] and t not in place[3]:
                    place[3][t] = ms, [a.tolist() if hasattr(a, "tolist") else a for a in value.tolist()]
                place[1] = max(place[1], ms)
        watermark, sent, ended, due = state.getCurrentWatermarkMs(), ([], [], []), [], []
        for episode, place in lane.items():
            next_, last, recent, waiting = place
            for t in sorted(waiting):
                if t > next_ and waiting[t][0] > watermark:
                    break
                recent = [*recent, (t, waiting.pop(t)[1])][-self.size :]
                for column, x in zip(sent, (episode, t, self.of_held(recent))):
                    column.append(x)
                next_ = t + 1
            place[0], place[2] = next_, recent
            ends = last + self.idle_ms
            if ends <= watermark:
                ended.append(episode)
            else:
                due.append(min([ends, *(ms for ms, _ in waiting.values())]))
        for episode in ended:
            del lane[episode]
        if lane:
            state.update((pickle.dumps(lane, pickle.HIGHEST_PROTOCOL),))
            state.setTimeoutTimestamp(max(min(due), watermark + 1))
        elif state.exists:
            state.remove()
        if sent[0]:
            yield pd.DataFrame(dict(zip(("episode_id", "t", "out"), sent)))


def _ordered(steps: DataFrame, steps_out: OrderedSteps, output: str, delay: str, lanes: int) -> DataFrame:
    lane = F.pmod(F.xxhash64("episode_id"), F.lit(lanes)).cast("int").alias("__lane")
    known = F.col("episode_id").isNotNull().alias("__known"), F.coalesce("episode_id", F.lit(0)).cast("long").alias("__episode")
    marked = steps.withWatermark("ts", delay).select(lane, *known, "t", "ts", F.unix_millis("ts").alias("__ms"), "value")
    return marked.groupBy("__lane").applyInPandasWithState(steps_out, output, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def live_history(steps: DataFrame, size: int, delay: str = "1 hour", idle_ms: int = 3_600_000, lanes: int = LANES) -> DataFrame:
    """(episode_id, t, out): the last `size` actions of the episode, padded in front.

    steps: episode_id, t from 0, ts, value array<double>, in any order; `delay`: how late a step may come (see OrderedSteps).
    """
    def padded(held: list) -> list:
        actions = [list(a) for _, a in held]
        return [[PAD] * len(actions[-1])] * (size - len(actions)) + actions

    return _ordered(steps, OrderedSteps(size, padded, idle_ms), "episode_id long, t int, out array<array<double>>", delay, lanes)


def live_ensemble(steps: DataFrame, horizon: int, temperature: float, delay: str = "1 hour", idle_ms: int = 3_600_000, lanes: int = LANES) -> DataFrame:
    """(episode_id, t, out): weighted mean of what the last `horizon` plans foresaw for t, weight exp(-temperature * i), 0 the oldest.

    steps: episode_id, t from 0, ts, value array<array<double>> (the plan made at t), in any order.
    """
    def mean(held: list) -> list:
        import numpy as np

        t = held[-1][0]
        seen = [plan[t - made] for made, plan in held if 0 <= t - made < len(plan)]
        w = np.exp(-temperature * np.arange(len(seen)))
        return list(map(float, (np.array(seen) * (w / w.sum())[:, None]).sum(0)))

    return _ordered(steps, OrderedSteps(horizon, mean, idle_ms), "episode_id long, t int, out array<double>", delay, lanes)


def _stateful(steps: DataFrame, processor: StatefulProcessor, key: str, output: str, delay: str) -> DataFrame:
    marked = steps.withWatermark("ts", delay)
    return marked.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="append", timeMode="eventTime")


class Batches(StatefulProcessor):
    """Per lane: frames of any trajectories wait until there are `size`, go through the model together, and go out once their trajectory is whole.

    What waits outlives micro-batches, so each batch has exactly `size` frames but those that drain a lane: when the watermark is
    `idle` past the last frame, the rest goes through in one smaller batch, and trajectories go out as far as they came.

    place: (batches so far, last frame's time, when the lane is drained); waiting: frames for the model; done: frames with a score of
    trajectories that are not whole, packed many to a value, so that a frame that waits costs no row of state.
    """

    PACKED = 100_000  # frames in a value of state

    def __init__(self, size: int, score: Callable, idle_ms: int) -> None:
        self.size, self.score, self.idle_ms = size, score, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "batches long, last long, ends long")
        self.waiting = handle.getListState("waiting", "episode_id long, t int, n int, value array<double>")
        self.done = handle.getListState("done", "frames binary")

    KIND = [("episode_id", "i8"), ("t", "i4"), ("n", "i4"), ("score", "f8"), ("batch", "i8"), ("batch_rows", "i4")]

    def _through(self, frames: list, number: int):
        import numpy as np

        out = np.zeros(len(frames), self.KIND)
        out["episode_id"], out["t"], out["n"], _ = zip(*frames)
        out["score"], out["batch"], out["batch_rows"] = self.score(np.array([v for *_, v in frames], float)), number, len(frames)
        return out

    def _stored(self) -> list:
        import numpy as np

        return [np.frombuffer(x[0], self.KIND) for x in self.done.get()] if self.done.exists() else []

    def _out(self, lane: int, parts: list) -> Iterator:
        import numpy as np
        import pandas as pd

        rows = np.concatenate([np.zeros(0, self.KIND), *parts])
        yield pd.DataFrame({"lane": np.full(len(rows), lane, np.int32), **{c: rows[c].copy() for c in ("episode_id", "t", "score", "batch", "batch_rows")}})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np

        batches, last, ends = self.place.get() if self.place.exists() else (0, 0, 0)
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        done = self._stored()
        for frame in rows:
            frame = frame[frame["episode_id"].notna()]  # rows without an episode only move the clock
            if not len(frame):
                continue
            last = max(last, _millis(frame["ts"].max()))
            waiting += zip(*(frame[c].astype("int64").tolist() for c in ("episode_id", "t", "n")), (v.tolist() for v in frame["value"]))
            full = len(waiting) // self.size * self.size
            for at in range(0, full, self.size):
                done.append(self._through(waiting[at : at + self.size], batches))
                batches += 1
            waiting = waiting[full:]
        if not last:
            return
        frames = np.concatenate([np.zeros(0, self.KIND), *done])
        _, which, count = np.unique(frames["episode_id"], return_inverse=True, return_counts=True)
        is_whole = count[which] >= frames["n"]
        whole, left = frames[is_whole], frames[~is_whole]
        packed = [(left[at : at + self.PACKED].tobytes(),) for at in range(0, len(left), self.PACKED)]
        for state, kept in ((self.waiting, waiting), (self.done, packed)):
            state.put(kept) if kept else state.clear()
        if ends:
            self.handle.deleteTimer(ends)
        ends = last + self.idle_ms
        self.handle.registerTimer(ends)
        self.place.update((batches, last, ends))
        yield from self._out(int(key[0]), [whole])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        batches = self.place.get()[0] if self.place.exists() else 0
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        done = self._stored()
        if waiting:
            done.append(self._through(waiting, batches))
        for state in (self.place, self.waiting, self.done):
            state.clear()
        yield from self._out(int(key[0]), done)

    def close(self) -> None:
        pass


def model_batches(frames: DataFrame, score: Callable, size: int, lanes: int, delay: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """(lane, episode_id, t, score, batch, batch_rows) of every frame, once its trajectory is whole.

    frames: episode_id, t, n (frames of the trajectory), ts, value array<double>, in any order. A trajectory's frames share a lane with those of others;
    `score` takes a matrix of frames, `size` of them but for a lane's last, and returns a number for each. `lanes` is the parallelism.
    """
    lane = F.pmod(F.xxhash64("episode_id"), F.lit(lanes)).cast("int")
    out = "lane int, episode_id long, t int, score double, batch long, batch_rows int"
    return _stateful(frames.withColumn("lane", lane), Batches(size, score, idle_ms), "lane", out, delay)


def drained_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream in append mode over all that is there now into Parquet files; a restart with the checkpoint adds nothing twice."""
    with keyed_state(stream.sparkSession):
        q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


_COUNTS = "batch long, task string, episodes long, successes long"


def counts_in(spark: SparkSession, path: str) -> DataFrame:
    """task, episodes, successes so far of a table that `merge_counts` keeps."""
    slots = spark.read.schema(_COUNTS + ", slot int").parquet(path)
    last = slots.agg(F.max("batch").alias("__last"))
    return slots.join(F.broadcast(last), F.col("batch") == F.col("__last")).where("task IS NOT NULL OR episodes > 0").select("task", "episodes", "successes")


def merge_counts(ended: DataFrame, batch: int, path: str) -> None:
    """Add a micro-batch of episode ends (task, success) to the counts of the batches before it.

    Two folders take turns: batch b replaces the totals of b - 2 by those of b - 1 and its own. So a batch that is run again after a crash, before or
    after its write, gives the same totals, and readers always have a whole table.
    """
    spark = ended.sparkSession
    own = ended.groupBy("task").agg(F.count(F.lit(1)).alias("episodes"), F.sum(F.col("success").cast("long")).alias("successes"))
    if batch:
        before = spark.read.schema(_COUNTS).parquet(f"{path}/slot={(batch - 1) % 2}").where(F.col("batch") == batch - 1)
        own = own.unionByName(before.where("task IS NOT NULL OR episodes > 0").select("task", "episodes", "successes"))
    totals = own.groupBy("task").agg(F.sum("episodes").alias("episodes"), F.sum("successes").alias("successes"))
    mark = spark.createDataFrame([(None, 0, 0)], "task string, episodes long, successes long")  # a batch without rows leaves its number too
    totals.unionByName(mark).select(F.lit(batch).cast("long").alias("batch"), "*").write.mode("overwrite").parquet(f"{path}/slot={batch % 2}")


def count_episodes(steps: DataFrame, path: str, checkpoint: str):
    """Run a stream of steps (task, done, success) over all that is there now into the counts of finished episodes at `path`."""
    def add(frame: DataFrame, batch: int) -> None:
        merge_counts(frame, batch, path)

    q = steps.where("done").select("task", "success").writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
