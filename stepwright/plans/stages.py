"""Queries of standardization recipes, scans of record layouts, Python stages and live streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rotations
from ..functions.keyed import numbered
from ..operators import standardize as S
from ..operators import stages as G

from ..sources import formats, records
from ..sources.steps import EVENT_STEPS, LINE_STEPS, embedding_steps, event_steps, line_steps, rephrases, table
from ..sources.storage import scratch, swap, written
from ..streaming import live
from .base import query
from .recipes import wrist_sql

ID = ["episode_id", "t"]


def out(df, actions, proprios, places=6):
    a = [F.round(F.get("action", F.lit(i)), places).alias(f"a{i}") for i in actions]
    return df.select(*ID, F.size("action").alias("n_action"), F.size("proprio").alias("n_proprio"), *a, *[F.round(F.get("proprio", F.lit(i)), places).alias(f"p{i}") for i in proprios])


def raw(spark, sf_dir):
    """Raw steps of seven action dims and seven state dims, made of value and k."""
    steps = event_steps(spark, sf_dir)
    v, k = F.col("action")[0], F.col("action")[1]
    vec = lambda base: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: base + i)
    return steps.withColumns({"action": F.concat(vec(v), F.array(k)), "state": F.concat(vec(v * 2), F.array(k / 2))})


RAW = EVENT_STEPS


@query("std_bridge_orig", f"""
WITH {RAW}, s1 AS (SELECT episode_id, t - 1 AS t, n - 1 AS n, a0, a1 FROM steps WHERE t >= 1),
g AS (SELECT *, CASE WHEN a1 > 0.95 THEN 1.0 WHEN a1 < 0.05 THEN 0.0 END AS d FROM s1),
h AS (SELECT *, coalesce(first_value(d IGNORE NULLS) OVER w, last_value(a1) OVER w) AS grip, lead(a0) OVER (PARTITION BY episode_id ORDER BY t) AS nxt FROM g WINDOW w AS (PARTITION BY episode_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT episode_id, CAST(t AS INT) AS t, CAST(7 AS INT) AS n_action, CAST(7 AS INT) AS n_proprio, round((nxt - a0) * 2, 6) AS a0, round(grip, 6) AS a6, round(a0 * 2, 6) AS p0, round(a1 / 2, 6) AS p6 FROM h WHERE nxt IS NOT NULL
""")
def std_bridge_orig(spark, sf_dir):
    return out(S.standardize(raw(spark, sf_dir), "bridge_orig"), [0, 6], [0, 6])


@query("std_rt1", f"""
WITH {RAW}, d AS (SELECT *, CASE WHEN a1 * 2 - 1 < -0.1 THEN 1.0 WHEN a1 * 2 - 1 > 0.1 THEN -1.0 END AS move FROM steps)
SELECT episode_id, t, CAST(7 AS INT) AS n_action, CAST(1 AS INT) AS n_proprio, round(a0, 6) AS a0, round(a0 + 3, 6) AS a3, CAST(coalesce(
  last_value(move IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY t ROWS UNBOUNDED PRECEDING),
  -first_value(move IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) / 2 + 0.5 AS DOUBLE) AS a6, 0.0 AS p0 FROM d
""")
def std_rt1(spark, sf_dir):
    r = raw(spark, sf_dir).withColumns({"world_vector": F.slice("action", 1, 3), "rotation_delta": F.slice("action", 4, 3), "gripper_closedness_action": F.array(F.col("action")[6] * 2 - 1), "natural_language_instruction": F.col("language_instruction")})
    return out(S.standardize(r, "rt1"), [0, 3, 6], [0])


@query("std_language_table", f"WITH {RAW} SELECT episode_id, t, text, CAST(7 AS INT) AS n_action, round(a0, 6) AS a0, 0.0 AS a2, 1.0 AS a6 FROM steps")
def std_language_table(spark, sf_dir):
    """The instruction is an array of code points that ends at the first zero."""
    codes = F.concat(F.transform(F.split("language_instruction", ""), lambda c: F.ascii(c)), F.array(F.lit(0), F.lit(65)))
    r = event_steps(spark, sf_dir).withColumn("language_instruction", G.text_of_codes(codes))
    s = S.standardize(r, "language_table")
    return s.select(*ID, F.col("language_instruction").alias("text"), F.size("action").alias("n_action"), F.round(F.col("action")[0], 6).alias("a0"), F.col("action")[2].alias("a2"), F.col("action")[6].alias("a6"))


@query("std_libero", f"WITH {RAW} SELECT episode_id, t, CAST(7 AS INT) AS n_action, CAST(8 AS INT) AS n_proprio, round(a0, 6) AS a0, round(1 - greatest(0, least(1, a1)), 6) AS a6, round(a0 * 2, 6) AS p0, round(a0 * 2 + 5, 6) AS p6, round(a1 / 2, 6) AS p7 FROM steps")
def std_libero(spark, sf_dir):
    return out(S.standardize(raw(spark, sf_dir), "libero"), [0, 6], [0, 6, 7])


@query("std_droid_baseact", f"WITH {RAW} SELECT episode_id, t, CAST(7 AS INT) AS n_action, CAST(7 AS INT) AS n_proprio, round(a0, 6) AS a0, round(1 - a1, 6) AS a6, round(a0 * 2, 6) AS p0, round(a1 / 2, 6) AS p6 FROM steps")
def std_droid_baseact(spark, sf_dir):
    r = raw(spark, sf_dir).withColumns({"cartesian_velocity": F.slice("action", 1, 6), "gripper_position": F.slice("action", 7, 1), "state_cartesian": F.slice("state", 1, 6), "state_gripper": F.slice("state", 7, 1)})
    return out(S.standardize(r, "droid_baseact"), [0, 6], [0, 6])


@query("recipe_names", "SELECT name, n_action FROM (VALUES ('bridge_dataset', 7), ('fractal20220817_data', 7), ('tdroid_carrot_in_bowl', 7), ('aloha1_fold_shirt_30_demos', 7), ('libero_10_no_noops', 7), ('kaist_nonprehensile_converted_externally_to_rlds', 7)) r(name, n_action) WHERE (SELECT count(*) FROM events) > 0")
def recipe_names(spark, sf_dir):
    """Published dataset names lead to their recipes."""
    parts = {"world_vector": F.slice("action", 1, 3), "rotation_delta": F.slice("action", 4, 3), "gripper_closedness_action": F.slice("action", 7, 1), "cartesian_position": F.col("state"), "gripper_position": F.slice("state", 7, 1)}
    r = raw(spark, sf_dir).withColumns(parts)
    names = ["bridge_dataset", "fractal20220817_data", "tdroid_carrot_in_bowl", "aloha1_fold_shirt_30_demos", "libero_10_no_noops", "kaist_nonprehensile_converted_externally_to_rlds"]
    made = [S.standardize(r, n).select(F.lit(n).alias("name"), F.size("action").alias("n_action")).distinct() for n in names]
    return reduce(DataFrame.unionByName, made)


# ---------------------------------------------------------------- scans and sinks
@query("scan_steps", f"WITH {EVENT_STEPS} SELECT episode_id, t, n, a0, round(a1, 9) AS a1, text FROM steps")
def scan_steps(spark, sf_dir):
    return event_steps(spark, sf_dir).select(*ID, "n", F.col("action")[0].alias("a0"), F.round(F.col("action")[1], 9).alias("a1"), F.col("language_instruction").alias("text"))


@query("to_step_rows", f"WITH {EVENT_STEPS} SELECT event_type AS task, count(*) AS n, round(sum(a0), 4) AS total FROM steps GROUP BY 1")
def to_step_rows(spark, sf_dir):
    """Episodes as arrays of steps, exploded, written by task and read again."""
    episodes = event_steps(spark, sf_dir).groupBy("dataset_name", "episode_id").agg(F.collect_list(F.struct("t", "action", F.col("event_type").alias("task"))).alias("steps"))
    rows = episodes.select("episode_id", F.explode("steps").alias("s")).select("episode_id", "s.*")
    stored = written(rows, scratch(spark), ["task"])
    return stored.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("action")[0]), 4).alias("total"))


@query("optional_cols", f"WITH {EVENT_STEPS} SELECT episode_id, t, CAST(NULL AS DOUBLE) AS effort0, a0 AS first FROM steps")
def optional_cols(spark, sf_dir):
    rows = S.optional_columns(event_steps(spark, sf_dir), {"effort": T.ArrayType(T.DoubleType()), "action": T.ArrayType(T.DoubleType())})
    return rows.select(*ID, F.get("effort", F.lit(0)).alias("effort0"), F.get("action", F.lit(0)).alias("first"))


@query("lerobot_scan", f"WITH {LINE_STEPS} SELECT episode_id AS episode_index, count(*) AS n, sum(a0) AS total FROM steps WHERE episode_id % 8 IN (0, 1) GROUP BY 1")
def lerobot_scan(spark, sf_dir):
    """Episodes laid out as slices [from, to) of data files in chunks, then scanned for two chunks."""
    steps = line_steps(spark, sf_dir)
    placed = steps.select((F.col("episode_id") % 8).alias("chunk_index"), (F.floor(F.col("episode_id") / 8) % 2).alias("file_index"), "episode_id", "t", F.col("action")[0].alias("x"))
    indexed = numbered(placed, ["chunk_index", "file_index", "episode_id", "t"], "index")
    folder = scratch(spark)
    data = written(indexed.select("chunk_index", "file_index", "index", "x"), f"{folder}/data", ["chunk_index"])
    meta = indexed.groupBy("chunk_index", "file_index", F.col("episode_id").alias("episode_index")).agg(F.min("index").alias("dataset_from_index"), (F.max("index") + 1).alias("dataset_to_index"))
    episodes = written(meta, f"{folder}/meta")
    rows = records.episode_frames(episodes, data, [0, 1])
    return rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


@query("lerobot_source", f"WITH {EVENT_STEPS} SELECT layout, episode_id AS episode_index, count(*) AS n, round(sum(a0), 4) AS total FROM steps, (SELECT unnest(['files', 'jsonl']) AS layout) WHERE episode_id // 16 IN (0, 2) GROUP BY ALL")
def lerobot_source(spark, sf_dir):
    """Episodes written in both layouts and read as a data source, two chunks of them."""
    formats.register(spark)
    steps = event_steps(spark, sf_dir).select(F.col("episode_id").alias("episode_index"), "t", F.col("action")[0].alias("x"))
    placed = steps.withColumns({"chunk_index": F.floor(F.col("episode_index") / 16).cast("int"), "file_index": (F.floor(F.col("episode_index") / 4) % 4).cast("int")})
    frames = numbered(placed, ["episode_index", "t"], "index")
    out = []
    for layout in ("files", "jsonl"):
        folder = scratch(spark)
        formats.write_episodes(frames, folder, layout, 16)
        rows = spark.read.format("lerobot").option("chunks", "0,2").load(folder)
        out.append(rows.groupBy(F.lit(layout).alias("layout"), "episode_index").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total")))
    return out[0].unionByName(out[1])


@query("embedding_shards", "SELECT vec_id, CAST(label AS BIGINT) AS traj_id, CAST(label % 8 AS INT) AS shard, CAST(len(embedding) AS INT) AS dims FROM embeddings WHERE vec_id % 7 <> 0")
def embedding_shards(spark, sf_dir):
    """Trajectories dealt over eight shards: half are written, a second run adds what the manifest lacks; every seventh vector is cut short and skipped."""
    formats.register(spark)
    e = embedding_steps(spark, sf_dir).select("vec_id", "traj_id", F.when(F.col("vec_id") % 7 == 0, F.slice("ext1", 1, 10)).otherwise(F.col("ext1")).alias("ext1"), F.pmod("traj_id", F.lit(8)).cast("int").alias("shard"))
    folder = scratch(spark)
    formats.write_missing_shards(e.where("shard < 4"), folder, 8)
    formats.write_missing_shards(e, folder, 8)
    rows = spark.read.format("embedding_shards").option("vector", "ext1").option("dim", 64).load(folder)
    return rows.select("vec_id", "traj_id", "shard", F.size("ext1").alias("dims"))


@query("table_swap", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice * 2), 2) AS total FROM orders GROUP BY 1")
def table_swap(spark, sf_dir):
    """A table replaced by one made from itself."""
    path = scratch(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.parquet(path)
    swap(spark, spark.read.parquet(path).withColumn("o_totalprice", F.col("o_totalprice") * 2), path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---------------------------------------------------------------- Python stages
@query("sticky_gripper", f"""
WITH RECURSIVE {EVENT_STEPS}, c AS (SELECT episode_id, t, coalesce(lag(a1) OVER (PARTITION BY episode_id ORDER BY t) - a1, 0) AS change FROM steps),
r AS (
  SELECT episode_id, t, change AS sent, (abs(change) > 0.5)::INT AS running FROM c WHERE t = 0
  UNION ALL
  SELECT c.episode_id, c.t, CASE WHEN r.running BETWEEN 1 AND 4 THEN r.sent ELSE c.change END, CASE WHEN r.running BETWEEN 1 AND 4 THEN r.running + 1 ELSE (abs(c.change) > 0.5)::INT END
  FROM r JOIN c ON c.episode_id = r.episode_id AND c.t = r.t + 1)
SELECT episode_id, t, CAST(CASE WHEN running > 0 THEN greatest(-1, least(1, sent)) ELSE 0 END AS DOUBLE) AS gripper FROM r
""")
def sticky_gripper(spark, sf_dir):
    return G.sticky_gripper(event_steps(spark, sf_dir), F.col("action")[1], 5).select(*ID, "gripper")


@query("wrist_frame", f"""
WITH {EVENT_STEPS}, v AS (SELECT episode_id, t, list_transform(range(1, 7), lambda i: a0 / (i * 50.0)) AS v, list_transform(range(1, 7), lambda i: a1 / i) AS p FROM steps),
turned AS (SELECT *, {wrist_sql("v", "p")[0]} FROM v), made AS (SELECT episode_id, t, {wrist_sql("v", "p")[1]} AS m FROM turned)
SELECT episode_id, t, {", ".join(f"round(m[{i + 1}], 6) AS a{i}" for i in range(9))} FROM made
""")
def wrist_frame(spark, sf_dir):
    six = lambda x: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: x / (i * 50.0))
    steps = event_steps(spark, sf_dir).withColumns({"velocity": six(F.col("action")[0]), "pose": six(F.col("action")[1] * 50)})
    return steps.select(*ID, rotations.wrist_frame(F.col("velocity"), F.col("pose")).alias("m")).select(*ID, *[F.round(F.col("m")[i], 6).alias(f"a{i}") for i in range(9)])


@query("zlib_vectors", "SELECT vec_id, round(embedding[1], 6) AS first, CAST(64 AS INT) AS n FROM embeddings")
def zlib_vectors(spark, sf_dir):
    @F.pandas_udf("binary")
    def pack(v):
        import zlib

        import numpy as np

        return v.map(lambda x: zlib.compress(np.asarray(x, "<f4").tobytes()))

    packed = table(spark, sf_dir, "embeddings").select("vec_id", pack("embedding").alias("blob"))
    return G.unpacked_floats(packed, "blob", "v").select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.size("v").alias("n"))


@query("image_resize")
def image_resize(spark, sf_dir):
    """The bytes of whole pages as images, 10 pixels of three channels a row, made small; every tenth is blank and so padding.

    The last row of pixels is filled up with zeros. The second column holds varied and turned images, the third both side by side.
    """
    html = F.col("html").cast("binary")
    height = F.ceil(F.octet_length(html) / 30)
    full = F.concat(html, F.unhex(F.repeat(F.lit("00"), (height * 30 - F.octet_length(html)).cast("int"))))
    rows = table(spark, sf_dir, "pages").select("page_id", height.alias("height"), F.lit(10).alias("width"), F.when(F.col("page_id") % 10 != 0, full).alias("data"))
    small = G.prepared_images(rows, ["page_id"], 6, 6)
    varied = G.prepared_images(rows, ["page_id"], 6, 6, augment_seed="page_id", rotate=True).withColumnRenamed("pixels", "varied")
    both = G.side_by_side(small.join(varied, "page_id"), ["pixels", "varied"], 6, "both")
    return both.select("page_id", F.crc32("pixels").alias("crc"), F.crc32("varied").alias("varied_crc"), F.crc32("both").alias("both_crc"))


@query("text_similarity")
def text_similarity(spark, sf_dir):
    pairs = rephrases(spark, sf_dir).select("doc_id", "pos", F.col("original").alias("a"), F.col("rephrase").alias("b"))
    return G.similarity_ratios(pairs, "a", "b").select("doc_id", "pos", F.round("similarity", 6).alias("similarity"))


@query("batched_encode", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS score FROM embeddings")
def batched_encode(spark, sf_dir):
    """A stand-in for a caller's model: the squared length of each vector, 128 rows at a time."""
    def squared(rows):
        import numpy as np

        m = np.stack(rows["ext1"].to_numpy()).astype(float)
        return (m * m).sum(1)

    e = embedding_steps(spark, sf_dir).select("vec_id", "ext1")
    return G.scored(e, squared, ["ext1"], 128).select("vec_id", F.round("score", 5).alias("score"))


# ---------------------------------------------------------------- streams over step files
def streamed(spark, rows, schema, files=12, per_batch=4):
    """Rows (with ts, 60 s a step) dealt at random over files, which are read as a stream in an order that nobody settles; then checkpoint and output folders.

    Steps come as late as the whole table is long, so the streams' delay has to be that long.
    """
    path = scratch(spark)
    dealt = rows.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t") * 60))
    dealt.repartition(files, F.xxhash64("episode_id", "t")).write.parquet(path)
    return live.step_stream(spark, path, schema, per_batch), f"{path}-checkpoint", f"{path}-out"


LATE = "10000 days"


@query("stream_history", f"""
WITH {EVENT_STEPS} SELECT a.episode_id, a.t, round(coalesce(b.a0, -5.0), 6) AS oldest, round(a.a0, 6) AS newest FROM steps a LEFT JOIN steps b ON b.episode_id = a.episode_id AND b.t = a.t - 3
""")
def stream_history(spark, sf_dir):
    steps = event_steps(spark, sf_dir).select("episode_id", "t", F.col("action").alias("value"))
    stream, checkpoint, folder = streamed(spark, steps, "episode_id long, t int, value array<double>, ts timestamp")
    rows = live.drained_to_files(live.live_history(stream, 4, LATE), folder, checkpoint)
    return rows.select(*ID, F.round(F.col("out")[0][0], 6).alias("oldest"), F.round(F.col("out")[3][0], 6).alias("newest"))


@query("stream_ensemble", f"""
WITH {EVENT_STEPS}, p AS (SELECT a.episode_id, a.t, a.t - b.t AS i, b.a0 + (a.t - b.t) * 0.5 AS x, exp(-0.3 * (row_number() OVER (PARTITION BY a.episode_id, a.t ORDER BY b.t) - 1)) AS w FROM steps a JOIN steps b ON b.episode_id = a.episode_id AND b.t BETWEEN a.t - 3 AND a.t)
SELECT episode_id, t, round(sum(w * x) / sum(w), 6) AS x FROM p GROUP BY ALL
""")
def stream_ensemble(spark, sf_dir):
    plan = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.col("action")[0] + i * 0.5, F.col("action")[1]))
    steps = event_steps(spark, sf_dir).select("episode_id", "t", plan.alias("value"))
    stream, checkpoint, folder = streamed(spark, steps, "episode_id long, t int, value array<array<double>>, ts timestamp")
    rows = live.drained_to_files(live.live_ensemble(stream, 4, 0.3, LATE), folder, checkpoint)
    return rows.select(*ID, F.round(F.col("out")[0], 6).alias("x"))


@query("stream_batches", f"""
WITH {EVENT_STEPS} SELECT episode_id, t, round(a0 * a0 + a1 * a1, 6) AS score FROM steps
""")
def stream_batches(spark, sf_dir):
    """A stand-in for a caller's model (squared length), 64 frames at a time over all trajectories of a lane; the last file moves the clock, which drains the lanes."""
    steps = event_steps(spark, sf_dir).select("episode_id", "t", "n", F.col("action").alias("value"))
    stream, checkpoint, folder = streamed(spark, steps, "episode_id long, t int, n int, value array<double>, ts timestamp")
    path = checkpoint.removesuffix("-checkpoint")
    after = steps.agg(F.max("t").alias("t")).select(F.lit(None).cast("long").alias("episode_id"), "t", F.lit(0).alias("n"), F.array().cast("array<double>").alias("value"))
    after.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("t", F.lit(0)) * 60 + 4_000_000_000)).write.mode("append").parquet(path)
    rows = live.drained_to_files(live.model_batches(stream, lambda m: (m * m).sum(1), 64, 8, "1 day"), folder, checkpoint)
    return rows.select(*ID, F.round("score", 6).alias("score"))


@query("stream_success", "SELECT event_type AS task, count(*) AS episodes, CAST(sum((user_id % 3 = 0)::INT) AS BIGINT) AS successes FROM events GROUP BY 1")
def stream_success(spark, sf_dir):
    path = scratch(spark)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.lit(True).alias("done"), (F.col("user_id") % 3 == 0).alias("success"))
    rows.repartition(3).write.parquet(path)
    stream = live.step_stream(spark, path, "task string, done boolean, success boolean")
    live.count_episodes(stream, f"{path}-counts", f"{path}-checkpoint")
    return live.counts_in(spark, f"{path}-counts")
