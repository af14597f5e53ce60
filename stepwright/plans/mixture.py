"""Queries of mixtures, splits, shards and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import draw_sql
from ..operators import mixture as M
from ..sources.steps import EVENT_STEPS, LINE_STEPS, TYPED_STEPS, embedding_steps, event_steps, line_steps, table
from .base import query
from .sequence import ID


def members(spark, sf_dir):
    """Regions as datasets: weight 1 for the first, else (key + 2) / 4, and their customers as size."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sizes = c.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    named = sizes.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(F.col("r_name").alias("dataset_name"), F.when(F.col("r_regionkey") == 0, 1.0).otherwise((F.col("r_regionkey") + 2) / 4).alias("weight"), "n")


MEMBERS = """
members AS (
  SELECT r_name AS dataset_name, CASE WHEN r_regionkey = 0 THEN 1.0 ELSE (r_regionkey + 2) / 4.0 END::DOUBLE AS weight, count(*) AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL),
shares AS (SELECT *, weight * n / sum(weight * n) OVER () AS share FROM members)
"""


@query("mixture_weights", f"WITH {MEMBERS} SELECT dataset_name, round(share, 9) AS share FROM shares")
def mixture_weights(spark, sf_dir):
    return M.mixture_weights(members(spark, sf_dir)).select("dataset_name", F.round("share", 9).alias("share"))


@query("effective_len", f"WITH {MEMBERS} SELECT CAST(floor(max(n / share)) AS BIGINT) AS effective_length FROM shares WHERE weight = 1.0")
def effective_len(spark, sf_dir):
    return M.effective_length(members(spark, sf_dir))


QUOTAS = MEMBERS + """,
q0 AS (SELECT *, share * {n} < 1 AS low, sum((share * {n} < 1)::INT) OVER () AS held, sum(share) FILTER (share * {n} >= 1) OVER () AS rest FROM shares),
q1 AS (SELECT *, CASE WHEN low THEN 1.0 ELSE share / rest * ({n} - held) END AS exact FROM q0),
q2 AS (SELECT *, greatest(1, floor(exact)) AS low_quota FROM q1),
quotas AS (SELECT dataset_name, CAST(low_quota + (row_number() OVER (ORDER BY exact - floor(exact) DESC, dataset_name) <= {n} - sum(low_quota) OVER ())::INT AS BIGINT) AS quota FROM q2)
"""


@query("apportion", f"WITH {QUOTAS.format(n=64)} SELECT * FROM quotas")
def apportion(spark, sf_dir):
    return M.apportioned(M.mixture_weights(members(spark, sf_dir)), 64, "dataset_name").select("dataset_name", "quota")


@query("mixture_sample", f"""
WITH {TYPED_STEPS},
sizes AS (SELECT dataset_name, count(*) AS size FROM steps GROUP BY 1),
quotas AS (SELECT dataset_name, size, CAST(CASE dataset_name WHEN 'view' THEN 2.5 WHEN 'click' THEN 1.0 ELSE 0.3 END * 2000 AS BIGINT) AS quota FROM sizes),
r AS (SELECT s.*, quota, size, row_number() OVER (PARTITION BY s.dataset_name ORDER BY {draw_sql('event_id', 4)}, event_id) AS r FROM steps s JOIN quotas USING (dataset_name))
SELECT dataset_name, event_id, CAST(unnest(range(1, 1 + CAST(quota // size + (r <= quota - quota // size * size)::INT AS BIGINT))) AS INT) AS copy FROM r
""")
def mixture_sample(spark, sf_dir):
    steps = event_steps(spark, sf_dir, by_type=True)
    share = F.when(F.col("dataset_name") == "view", 2.5).when(F.col("dataset_name") == "click", 1.0).otherwise(0.3)
    quotas = steps.select("dataset_name").distinct().withColumn("quota", (share * 2000).cast("long"))
    return M.mixture_sample(steps, quotas, F.col("event_id"), ["event_id"], 4).select("dataset_name", "event_id", "copy")


@query("interleaved", f"""
WITH {TYPED_STEPS},
m AS (SELECT dataset_name, event_id, row_number() OVER (PARTITION BY dataset_name ORDER BY {draw_sql('event_id', 14)}, event_id) - 1 AS number, count(*) OVER (PARTITION BY dataset_name) AS size FROM steps),
d AS (SELECT i AS position, CASE WHEN u < 0.5 THEN 'view' WHEN u < 0.875 THEN 'click' ELSE 'purchase' END AS dataset_name FROM (SELECT i, {draw_sql('i', 15)} AS u FROM range(6000) r(i))),
n AS (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY position) - 1 AS nth FROM d),
z AS (SELECT DISTINCT dataset_name, size FROM m)
SELECT position, nth // z.size AS epoch, n.dataset_name, event_id FROM n JOIN z USING (dataset_name) JOIN m ON m.dataset_name = n.dataset_name AND m.number = nth % z.size
""")
def interleaved(spark, sf_dir):
    """6000 positions over three event types, weights 4, 3 and 1; small members go through several epochs."""
    steps = event_steps(spark, sf_dir, by_type=True).select("dataset_name", "event_id")
    return M.interleaved(steps, [("view", 4.0), ("click", 3.0), ("purchase", 1.0)], 6000, F.col("event_id"), ["event_id"], 14, block=1000)


@query("shuffle_buffer", f"""
WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events),
a AS (SELECT event_id, min(position) OVER w + row_number() OVER (PARTITION BY position // 500 ORDER BY {draw_sql('position', 16)}, position) - 1 AS position FROM p WINDOW w AS (PARTITION BY position // 500)),
b AS (SELECT event_id, min(position) OVER w + row_number() OVER (PARTITION BY (position + 250) // 500 ORDER BY {draw_sql('position', 17)}, position) - 1 AS position FROM a WINDOW w AS (PARTITION BY (position + 250) // 500))
SELECT event_id, position FROM b
""")
def shuffle_buffer(spark, sf_dir):
    """Events in order of time through a buffer of 1000."""
    from ..functions.keyed import numbered

    placed = numbered(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], "position").select("event_id", "position")
    return M.buffer_shuffled(placed, "position", 1000, 16)


@query("mixture_dedup", "SELECT dataset_name, min(position) AS position FROM (SELECT o_orderpriority AS dataset_name, min(o_orderkey) AS position FROM orders GROUP BY 1 UNION ALL SELECT event_type, 5 FROM events GROUP BY 1 UNION ALL SELECT event_type, 2 FROM events WHERE event_type <> 'view' GROUP BY 1) WHERE dataset_name IN (SELECT event_type FROM events) GROUP BY 1")
def mixture_dedup(spark, sf_dir):
    names = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset_name")).agg(F.min("o_orderkey").alias("position"))
    types = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset_name")).distinct()
    both = names.union(types.withColumn("position", F.lit(5).cast("long"))).union(types.where("dataset_name <> 'view'").withColumn("position", F.lit(2).cast("long")))
    return M.dedup_members(both, types)


@query("split_95_5", f"WITH {EVENT_STEPS} SELECT episode_id, t, CASE WHEN {draw_sql('episode_id')} < 0.95 THEN 'train' ELSE 'val' END AS split FROM steps")
def split_95_5(spark, sf_dir):
    return M.split_episodes(event_steps(spark, sf_dir), F.col("episode_id")).select(*ID, "split")


@query("split_named", f"WITH {EVENT_STEPS} SELECT episode_id, t, CASE WHEN event_type = 'purchase' THEN 'val' ELSE 'train' END AS split FROM steps")
def split_named(spark, sf_dir):
    """A table that names its splits needs no fallback."""
    steps = event_steps(spark, sf_dir).withColumn("own", F.when(F.col("event_type") == "purchase", "val").otherwise("train"))
    return M.split_episodes(steps, F.col("episode_id"), named="own", fallback=False).select(*ID, "split")


@query("validation_take", f"SELECT event_id FROM events ORDER BY {draw_sql('event_id', 6)}, event_id LIMIT 256")
def validation_take(spark, sf_dir):
    """A shuffle buffer's worth of rows for validation."""
    return M.validation_rows(table(spark, sf_dir, "events").select("event_id"), F.col("event_id"), ["event_id"], 256, 6)


@query("split_fraction", f"SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {draw_sql('event_id', 8)}, event_id) <= CAST(floor(0.1 * (SELECT count(*) FROM events)) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM events")
def split_fraction(spark, sf_dir):
    return M.split_fraction(table(spark, sf_dir, "events").select("event_id"), F.col("event_id"), ["event_id"], 0.1, 8)


@query("split_multiple", """
WITH c AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)
SELECT o_orderkey, CASE WHEN r <= (n - 1000) // 32 * 32 THEN 'train' WHEN r > n - 1000 // 32 * 32 THEN 'eval' END AS split FROM r, c
""")
def split_multiple(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    top = orders.agg(F.max("o_orderkey").alias("__top"))
    placed = orders.join(F.broadcast(top))  # one row
    return M.split_multiple(placed, F.col("o_orderkey") / (F.col("__top") + 1), ["o_orderkey"], 1000).select("o_orderkey", "split")


@query("shard_assign", f"WITH {EVENT_STEPS} SELECT episode_id % 16 AS s, count(*) AS n, count(DISTINCT episode_id) AS episodes FROM steps GROUP BY 1")
def shard_assign(spark, sf_dir):
    rows = M.assigned_shard(event_steps(spark, sf_dir), F.col("episode_id"), 16)
    return rows.groupBy(F.col("shard").cast("long").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("episode_id").alias("episodes"))


@query("shard_resume", f"WITH {EVENT_STEPS} SELECT episode_id, t, episode_id % 16 AS shard FROM steps")
def shard_resume(spark, sf_dir):
    """All shards are written, then those from 12 on once more; the others stay as they were."""
    from ..sources.storage import scratch

    path = scratch(spark)
    rows = M.assigned_shard(event_steps(spark, sf_dir), F.col("episode_id"), 16).select(*ID, "shard")
    M.write_shards(rows, path)
    M.write_shards(rows, path, start=12)
    return spark.read.parquet(path)


@query("chunk_list", "WITH c AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) SELECT o_orderkey, CAST((r - 1) // CAST(ceil(n / 7.0) AS BIGINT) AS INT) AS chunk FROM r, c")
def chunk_list(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    top = orders.agg(F.max("o_orderkey").alias("__top"))
    return M.chunk_of(orders.join(F.broadcast(top)), F.col("o_orderkey") / (F.col("__top") + 1), ["o_orderkey"], 7).select("o_orderkey", "chunk")


@query("subsample_steps", f"WITH {EVENT_STEPS} SELECT episode_id, t FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY {draw_sql('event_id', 2)}, t) AS r FROM steps) WHERE r <= 12")
def subsample_steps(spark, sf_dir):
    return M.subsample_steps(event_steps(spark, sf_dir), F.col("event_id"), 12, 2).select(*ID)


@query("uniform_frames", f"SELECT event_id FROM events ORDER BY {draw_sql('event_id', 6)}, event_id LIMIT 200")
def uniform_frames(spark, sf_dir):
    return M.uniform_rows(table(spark, sf_dir, "events").select("event_id"), F.col("event_id"), ["event_id"], 200, 6)


@query("global_shuffle", f"SELECT event_id, row_number() OVER (ORDER BY {draw_sql('event_id', 1)}, event_id) AS position FROM events")
def global_shuffle(spark, sf_dir):
    return M.global_shuffle(table(spark, sf_dir, "events").select("event_id"), F.col("event_id"), ["event_id"], 1)


@query("camera_pick", f"""
WITH {EVENT_STEPS}, v AS (SELECT *, 'a' || CAST(event_id AS VARCHAR) AS a, CASE WHEN text = 'error' THEN '' ELSE 'b' || CAST(event_id AS VARCHAR) END AS b, {draw_sql('episode_id', 7)} < 0.5 AS swap FROM steps)
SELECT episode_id, t, CASE WHEN swap THEN b ELSE a END AS ext1, CASE WHEN swap THEN a ELSE b END AS ext2, CASE WHEN swap AND b = '' THEN a WHEN swap THEN b ELSE a END AS picked FROM v
""")
def camera_pick(spark, sf_dir):
    steps = event_steps(spark, sf_dir).withColumns({"ext1": F.concat(F.lit("a"), F.col("event_id").cast("string")), "ext2": F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("b"), F.col("event_id").cast("string")))})
    rows = M.swapped_cameras(steps, "ext1", "ext2", F.col("episode_id"), 7)
    return rows.select(*ID, "ext1", "ext2", M.first_camera(F.col("ext1"), F.col("ext2")).alias("picked"))


@query("unique_actions", f"WITH {LINE_STEPS} SELECT episode_id, min(t) AS t, CAST(a0 AS BIGINT) // 10 AS id FROM steps GROUP BY episode_id, CAST(a0 AS BIGINT) // 10")
def unique_actions(spark, sf_dir):
    steps = line_steps(spark, sf_dir).withColumn("ids", F.array(F.floor(F.col("action")[0] / 10)))
    return M.unique_actions(steps, ["episode_id"], "ids", "t").select(*ID, F.col("ids")[0].alias("id"))


@query("best_of_n", f"""
WITH {LINE_STEPS}, b AS (SELECT episode_id, min_by(t, (-a2, t)) AS best, min_by(t, (abs(a0 - 25), t)) AS nearest, min(a3) AS now FROM steps GROUP BY 1)
SELECT episode_id, best AS by_score, nearest AS by_distance, CASE WHEN now < 0.02 THEN best ELSE 0 END AS gated FROM b
""")
def best_of_n(spark, sf_dir):
    steps = line_steps(spark, sf_dir).select("episode_id", "t", F.col("action")[2].alias("score"), F.abs(F.col("action")[0] - 25).alias("distance"), F.col("action")[3].alias("x"))
    now = steps.groupBy("episode_id").agg(F.min("x").alias("now"))
    c = steps.drop("x").join(now, "episode_id")
    by_score = M.best_of_n(c, ["episode_id"], "score", "t").select("episode_id", F.col("t").alias("by_score"))
    by_distance = M.best_of_n(c, ["episode_id"], "distance", "t", least=True).select("episode_id", F.col("t").alias("by_distance"))
    gated = M.best_of_n(c, ["episode_id"], "score", "t", current="now", below=0.02).select("episode_id", F.col("t").alias("gated"))
    return by_score.join(by_distance, "episode_id").join(gated, "episode_id")


@query("length_batches")
def length_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "en").alias("multimodal"), F.size(F.split("text", " ")).alias("length"))
    return M.length_batches(docs, "multimodal", "length", F.col("doc_id"), ["doc_id"], 32, 4)


@query("modality_lengths", "SELECT conv_id, bool_or(contains(text, 'the')) AS multimodal, CAST(sum(len(string_split(text, ' '))) AS BIGINT) + CASE WHEN bool_or(contains(text, 'the')) THEN 256 ELSE 0 END AS length FROM conversations GROUP BY conv_id")
def modality_lengths(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    per = c.groupBy("conv_id").agg(F.bool_or(F.col("text").contains("the")).alias("multimodal"), F.sum(F.size(F.split("text", " "))).alias("words"))
    return per.select("conv_id", "multimodal", (F.col("words") + F.when(F.col("multimodal"), 256).otherwise(0)).cast("long").alias("length"))


@query("permute_choices", f"""
WITH b AS (SELECT item_id, unnest([0, 1]) AS repeat FROM benchmark), o AS (SELECT item_id, repeat, unnest([0, 1, 2, 3]) AS i FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id, repeat ORDER BY {draw_sql('(item_id * 31 + repeat * 7 + i)', 3)}, i) AS place FROM o)
SELECT item_id, CAST(repeat AS INT) AS repeat, substr('ABCD', place, 1) AS letter FROM p WHERE i = 0
""")
def permute_choices(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").withColumn("options", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("option "), i.cast("string"))))
    return M.permuted_choices(items, "options", 0, F.col("item_id"), 2, seed=3).select("item_id", "repeat", "letter")


@query("union_corpora", f"""
WITH u AS (SELECT 'doc' AS kind, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'conv', conv_id * 10 + turn, length(text) FROM conversations)
SELECT kind, id, n, row_number() OVER (ORDER BY {draw_sql('id', 12)}, kind, id) AS position FROM u
""")
def union_corpora(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    b = table(spark, sf_dir, "conversations").select(F.lit("conv").alias("kind"), (F.col("conv_id") * 10 + F.col("turn")).alias("id"), F.length("text").cast("long").alias("n"))
    return M.global_shuffle(a.unionByName(b), F.col("id"), ["kind", "id"], 12)


@query("chunk_prune", "SELECT o_orderkey, CAST(o_orderkey % 8 AS BIGINT) AS chunk_index FROM orders WHERE o_orderkey % 8 IN (0, 1)")
def chunk_prune(spark, sf_dir):
    """Written by chunk, read with a filter on the partition column: only the two folders are listed."""
    from ..sources.records import chunk_filter
    from ..sources.storage import scratch, written

    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).alias("chunk_index"))
    stored = written(rows, scratch(spark), ["chunk_index"])
    return stored.where(F.col("chunk_index").isin(*chunk_filter("0, 1"))).select("o_orderkey", F.col("chunk_index").cast("long").alias("chunk_index"))


@query("emb_scan", "SELECT vec_id, CAST(label AS BIGINT) AS traj_id FROM embeddings WHERE vec_id % 7 <> 0")
def emb_scan(spark, sf_dir):
    """Rows whose vector lacks elements are skipped; every seventh is cut short first."""
    e = embedding_steps(spark, sf_dir).withColumn("ext1", F.when(F.col("vec_id") % 7 == 0, F.slice("ext1", 1, 10)).otherwise(F.col("ext1")))
    return e.where(F.size("ext1") == 64).select("vec_id", "traj_id")
