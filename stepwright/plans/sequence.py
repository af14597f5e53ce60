"""Queries of the sequence operators over the event and order step tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.keyed import draw_sql
from ..operators import filters as P
from ..operators import windows as W
from ..sources.steps import EVENT_STEPS, LINE_STEPS, embedding_steps, EMBEDDING_STEPS, event_steps, line_steps
from .base import query


def flat(df: DataFrame, column: str, keys: list[str], dims: int = 2) -> DataFrame:
    """A window as rows (keys, k, x0, x1, ...), rounded to 6 places."""
    long = df.select(*keys, F.posexplode(column).alias("k", "v"))
    return long.select(*keys, "k", *[F.round(F.get("v", F.lit(d)), 6).alias(f"x{d}") for d in range(dims)])


ID = ["episode_id", "t"]


def window_sql(low: str, high: str, x0: str, x1: str, where: str = "TRUE", steps: str = EVENT_STEPS) -> str:
    """Rows of a window: k counts from 0 at t + low; x0 and x1 are given the step's row s, place j and neighbour m."""
    return f"""
WITH {steps},
places AS (SELECT s.*, unnest(range(CAST({low} AS BIGINT), CAST({high} AS BIGINT) + 1)) AS o FROM steps s),
spots AS (SELECT *, t + o AS j FROM places)
SELECT p.episode_id, p.t, CAST(p.o - ({low}) AS INT) AS k, round({x0}, 6) AS x0, round({x1}, 6) AS x1
FROM spots p
LEFT JOIN steps m ON m.episode_id = p.episode_id AND m.t = p.j
LEFT JOIN steps f ON f.episode_id = p.episode_id AND f.t = 0
LEFT JOIN steps l ON l.episode_id = p.episode_id AND l.t = p.n - 1
WHERE {where}
"""


def _pad(c: str) -> str:
    return f"coalesce(m.{c}, -5.0)"


@query("window_centred_pad", window_sql("-6", "3", _pad("a0"), _pad("a1")))
def window_centred_pad(spark, sf_dir):
    return flat(W.padded_window(event_steps(spark, sf_dir), 6, 3), "action_window", ID)


@query("window_past_future_pad", window_sql("-4", "7", _pad("a0"), _pad("a1")))
def window_past_future_pad(spark, sf_dir):
    """past 4, the current step and 8 - 1 future steps."""
    return flat(W.padded_window(event_steps(spark, sf_dir), 4, 8 - 1), "action_window", ID)


def _clamp(c: str) -> str:
    return f"CASE WHEN p.j < 0 THEN f.{c} WHEN p.j >= p.n THEN l.{c} ELSE m.{c} END"


@query("window_centred_clamp", window_sql("-3", "3", _clamp("a0"), _clamp("a1")))
def window_centred_clamp(spark, sf_dir):
    return flat(W.padded_window(event_steps(spark, sf_dir), 3, 3, pad="edge"), "action_window", ID)


@query("window_past_pad", window_sql("-4", "0", _pad("a0"), _pad("a1")))
def window_past_pad(spark, sf_dir):
    return flat(W.padded_window(event_steps(spark, sf_dir), 4, 0), "action_window", ID)


@query("window_future_pad", window_sql("0", "4", _pad("a0"), _pad("a1")))
def window_future_pad(spark, sf_dir):
    return flat(W.padded_window(event_steps(spark, sf_dir), 0, 4), "action_window", ID)


@query("chunk_repeat_last", window_sql("0", "4", _clamp("a0"), _clamp("a1")))
def chunk_repeat_last(spark, sf_dir):
    return flat(W.padded_window(event_steps(spark, sf_dir), 0, 4, pad="last"), "action_window", ID)


_neutral = window_sql("-1", "3", "CASE WHEN p.j > p.n - 1 THEN 0.0 WHEN p.j < 0 THEN f.a0 ELSE m.a0 END", _clamp("a1"))


@query("chunk_neutral", _neutral)
def chunk_neutral(spark, sf_dir):
    return flat(W.chunk_neutral(event_steps(spark, sf_dir), 2, 3, [True, False]), "action_window", ID)


@query("chunk_neutral_goal", f"""
WITH {EVENT_STEPS},
goals AS (SELECT *, least(n - 1, t + 1 + CAST(floor({draw_sql('event_id', 3)} * greatest(n - t - 1, 1)) AS INT)) AS goal_t FROM steps),
places AS (SELECT g.*, unnest(range(-1, 4)) AS o FROM goals g)
SELECT p.episode_id, p.t, CAST(o + 1 AS INT) AS k, CASE WHEN p.t + o > p.goal_t THEN 0.0 ELSE round(m.a0, 6) END AS x0, round(m.a1, 6) AS x1
FROM places p JOIN steps m ON m.episode_id = p.episode_id AND m.t = greatest(0, least(p.t + o, p.goal_t))
""")
def chunk_neutral_goal(spark, sf_dir):
    goals = W.uniform_goals(event_steps(spark, sf_dir), F.col("event_id"), 3)
    return flat(W.chunk_neutral(goals, 2, 3, [True, False], "goal_t"), "action_window", ID)


@query("chunk_truncate", window_sql("-1", "3", _clamp("a0"), _clamp("a1"), "p.t < p.n - 3"))
def chunk_truncate(spark, sf_dir):
    return flat(W.chunk_truncate(event_steps(spark, sf_dir), 2, 3), "action_window", ID)


@query("temporal_pairs", f"""
WITH {EVENT_STEPS}
SELECT a.episode_id, a.t, a.text, a.a0 AS now0, b.a0 AS later0 FROM steps a JOIN steps b ON a.episode_id = b.episode_id AND b.t = a.t + 5
""")
def temporal_pairs(spark, sf_dir):
    pairs = W.lagged_pairs(event_steps(spark, sf_dir), 5)
    return pairs.select(*ID, F.col("language_instruction").alias("text"), F.col("action")[0].alias("now0"), F.col("later")[0].alias("later0"))


@query("temporal_triplets", f"""
WITH {EVENT_STEPS}
SELECT a.episode_id, a.t, a.a1 AS state, b.a1 AS later_state, round(sum(m.a0), 6) AS action_sum, count(*) AS n_actions
FROM steps a JOIN steps b ON a.episode_id = b.episode_id AND b.t = a.t + 3 JOIN steps m ON m.episode_id = a.episode_id AND m.t BETWEEN a.t AND a.t + 2
GROUP BY ALL
""")
def temporal_triplets(spark, sf_dir):
    rows = W.lagged_triplets(event_steps(spark, sf_dir), 3)
    actions = F.transform("actions", lambda a: a[0])
    return rows.select(*ID, F.col("proprio")[0].alias("state"), F.col("later")[0].alias("later_state"), F.round(A.total(actions), 6).alias("action_sum"), F.size("actions").cast("long").alias("n_actions"))


@query("multiview_rows", f"WITH {EMBEDDING_STEPS} SELECT traj_id, t, round(ext1[1], 5) AS e1, round(ext2[1], 5) AS e2, round(wrist[1], 5) AS w FROM views WHERE cameras_avail = 7")
def multiview_rows(spark, sf_dir):
    rows = embedding_steps(spark, sf_dir).where("cameras_avail = 7")
    return rows.select("traj_id", "t", *[F.round(F.col(c)[0].cast("double"), 5).cast("float").alias(a) for c, a in (("ext1", "e1"), ("ext2", "e2"), ("wrist", "w"))])


@query("relabel_reached", f"""
WITH {EVENT_STEPS}
SELECT a.episode_id, a.t, round(b.a1 - a.a1, 6) AS x0, round(b.a0 / 2 - a.a0 / 2, 6) AS x1 FROM steps a JOIN steps b ON a.episode_id = b.episode_id AND b.t = a.t + 1
""")
def relabel_reached(spark, sf_dir):
    rows = W.relabel_reached(event_steps(spark, sf_dir))
    return rows.select(*ID, F.round(F.col("action")[0], 6).alias("x0"), F.round(F.col("action")[1], 6).alias("x1"))


@query("binarize_gripper", f"""
WITH {EVENT_STEPS},
d AS (SELECT *, CASE WHEN a1 > 0.95 THEN 1.0 WHEN a1 < 0.05 THEN 0.0 END AS decided FROM steps)
SELECT episode_id, t, round(coalesce(
  first_value(decided IGNORE NULLS) OVER w, last_value(a1) OVER w), 6) AS gripper
FROM d WINDOW w AS (PARTITION BY episode_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
""")
def binarize_gripper(spark, sf_dir):
    return W.binarize_gripper(event_steps(spark, sf_dir), F.col("action")[1]).select(*ID, F.round("gripper", 6).alias("gripper"))


@query("rel2abs_gripper", f"""
WITH {EVENT_STEPS},
d AS (SELECT *, CASE WHEN a1 * 2 - 1 < -0.1 THEN 1.0 WHEN a1 * 2 - 1 > 0.1 THEN -1.0 END AS move FROM steps)
SELECT episode_id, t, CAST(coalesce(
  last_value(move IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY t ROWS UNBOUNDED PRECEDING),
  -first_value(move IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) / 2 + 0.5 AS DOUBLE) AS gripper FROM d
""")
def rel2abs_gripper(spark, sf_dir):
    return W.relative_to_absolute_gripper(event_steps(spark, sf_dir), F.col("action")[1] * 2 - 1).select(*ID, "gripper")


_goal = f"least(n - 1, t + 1 + CAST(floor({draw_sql('event_id', 3)} * greatest(n - t - 1, 1)) AS INT))"


@query("goal_uniform", f"""
WITH {EVENT_STEPS}, g AS (SELECT *, {_goal} AS goal_t FROM steps)
SELECT g.episode_id, g.t, g.goal_t, b.a0 AS goal0, b.text AS goal_text FROM g JOIN steps b ON b.episode_id = g.episode_id AND b.t = g.goal_t
""")
def goal_uniform(spark, sf_dir):
    goals = W.with_goal_columns(W.uniform_goals(event_steps(spark, sf_dir), F.col("event_id"), 3), ["action", "language_instruction"])
    return goals.select(*ID, "goal_t", F.col("goal_action")[0].alias("goal0"), F.col("goal_language_instruction").alias("goal_text"))


@query("task_dropout", f"""
WITH {EVENT_STEPS}, g AS (SELECT *, {_goal} AS goal_t, text = 'error' OR {draw_sql('event_id', 9)} < 0.4 AS keep_image FROM steps)
SELECT episode_id, t, keep_image, CASE WHEN keep_image THEN '' ELSE text END AS text, CASE WHEN keep_image THEN goal_t ELSE n - 1 END AS goal_t FROM g
""")
def task_dropout(spark, sf_dir):
    steps = event_steps(spark, sf_dir).withColumn("language_instruction", F.when(F.col("language_instruction") == "error", "").otherwise(F.col("language_instruction")))
    goals = W.by_name(W.GOAL_STRATEGIES, "uniform")(steps, F.col("event_id"), 3)
    rows = W.by_name(W.TASK_STRATEGIES, "delete_task_conditioning")(goals, F.col("event_id"), 0.4, 9)
    return rows.select(*ID, "keep_image", F.col("language_instruction").alias("text"), "goal_t")


@query("pad_mask_map", f"WITH {EVENT_STEPS} SELECT episode_id, t, text <> 'error' AS has_text, TRUE AS has_action FROM steps")
def pad_mask_map(spark, sf_dir):
    steps = event_steps(spark, sf_dir).withColumn("language_instruction", F.when(F.col("language_instruction") == "error", "").otherwise(F.col("language_instruction")))
    rows = W.pad_mask_map(steps, ["language_instruction", "action"])
    return rows.select(*ID, F.col("pad_mask_dict")["language_instruction"].alias("has_text"), F.col("pad_mask_dict")["action"].alias("has_action"))


@query("action_ensemble", f"""
WITH {EVENT_STEPS},
plans AS (SELECT s.episode_id, s.t AS made, s.n, i, s.t + i AS target FROM steps s, (SELECT unnest(range(0, 4)) AS i)),
aimed AS (
  SELECT p.episode_id, p.target, p.made, f.a0 + p.i * 0.5 AS x0, f.a1 AS x1,
    exp(-0.3 * (row_number() OVER (PARTITION BY p.episode_id, p.target ORDER BY p.made) - 1)) AS w
  FROM plans p JOIN steps f ON f.episode_id = p.episode_id AND f.t = p.made WHERE p.target < p.n)
SELECT episode_id, CAST(target AS INT) AS t, CAST(d AS INT) AS dim, round(sum(w * CASE d WHEN 0 THEN x0 ELSE x1 END) / sum(w), 6) AS x
FROM aimed, (SELECT unnest([0, 1]) AS d) GROUP BY ALL
""")
def action_ensemble(spark, sf_dir):
    """Plans repeat the current action, its first dim raised by 0.5 a step."""
    plan = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.col("action")[0] + i * 0.5, F.col("action")[1]))
    rows = W.action_ensemble(event_steps(spark, sf_dir).withColumn("plan", plan), "plan", 4, 0.3)
    return rows.select("episode_id", F.col("t").cast("int").alias("t"), "dim", F.round("x", 6).alias("x"))


@query("candidate_history", f"""
WITH {EVENT_STEPS}, p AS (SELECT s.*, unnest(range(-3, 1)) AS o FROM steps s)
SELECT p.episode_id, p.t, CAST(p.o + 3 AS INT) AS k, CASE WHEN o = 0 THEN round(p.a0 * 2, 6) ELSE coalesce(round(m.a0, 6), -5.0) END AS x0, CASE WHEN o = 0 THEN 1.0 ELSE coalesce(round(m.a1, 6), -5.0) END AS x1
FROM p LEFT JOIN steps m ON m.episode_id = p.episode_id AND m.t = p.t + p.o
""")
def candidate_history(spark, sf_dir):
    rows = W.history_with_candidate(event_steps(spark, sf_dir), F.array(F.col("action")[0] * 2, F.lit(1.0)), 4)
    return flat(rows, "history", ID)


@query("obs_history", f"""
WITH {EVENT_STEPS}, p AS (SELECT s.*, unnest(range(0, 3)) AS o FROM steps s)
SELECT p.episode_id, p.t, CAST(2 * p.o + c AS INT) AS k, CASE c WHEN 0 THEN 'm' || CAST(m.event_id AS VARCHAR) ELSE 'w' || CAST(m.event_id AS VARCHAR) END AS frame
FROM p JOIN steps m ON m.episode_id = p.episode_id AND m.t = CASE WHEN p.t >= 2 THEN p.t - 2 + p.o WHEN p.o <= p.t THEN p.o ELSE p.t END, (SELECT unnest([0, 1]) AS c)
""")
def obs_history(spark, sf_dir):
    steps = event_steps(spark, sf_dir).withColumns({"main": F.concat(F.lit("m"), F.col("event_id").cast("string")), "side": F.concat(F.lit("w"), F.col("event_id").cast("string"))})
    return W.recent_frames(steps, ["main", "side"], 3).select(*ID, F.posexplode("frames").alias("k", "frame"))


@query("chunk_playback", f"""
WITH {EVENT_STEPS}
SELECT s.episode_id, s.t, round(p.a0 + (s.t % 4), 6) AS x0, round(p.a1, 6) AS x1 FROM steps s JOIN steps p ON p.episode_id = s.episode_id AND p.t = s.t - s.t % 4
""")
def chunk_playback(spark, sf_dir):
    plan = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.col("action")[0] + i, F.col("action")[1]))
    rows = W.chunk_playback(event_steps(spark, sf_dir).withColumn("plan", plan), "plan", 4)
    return rows.select(*ID, F.round(F.col("played")[0], 6).alias("x0"), F.round(F.col("played")[1], 6).alias("x1"))


@query("linspace_picks", f"""
WITH {EVENT_STEPS}, p AS (SELECT s.*, list_transform(range(0, 5), lambda i: CAST(floor(i * (n - 1) / 4.0) AS INT)) AS picks FROM steps s)
SELECT episode_id, t, event_id FROM p WHERE list_contains(picks, t)
""")
def linspace_picks(spark, sf_dir):
    return W.evenly_spaced(event_steps(spark, sf_dir), 5).select(*ID, "event_id")


@query("drop_noops", f"""
WITH {EVENT_STEPS},
m AS (SELECT *, abs(a0) < 40.0 AS small, round(a1) AS g FROM steps),
f AS (SELECT *, min(CASE WHEN NOT small THEN t END) OVER (PARTITION BY episode_id) AS first_move, lag(g) OVER (PARTITION BY episode_id ORDER BY t) AS before FROM m)
SELECT episode_id, t, event_id FROM f WHERE NOT coalesce(small AND (first_move IS NULL OR t < first_move OR g = before), FALSE)
""")
def drop_noops(spark, sf_dir):
    rows = W.drop_noops(event_steps(spark, sf_dir), F.slice("action", 1, 1), F.round(F.col("action")[1]), 40.0)
    return rows.select(*ID, "event_id")


@query("drop_first", f"WITH {EVENT_STEPS} SELECT episode_id, CAST(t - 1 AS INT) AS t, CAST(n - 1 AS INT) AS n, event_id FROM steps WHERE t >= 1")
def drop_first(spark, sf_dir):
    return W.drop_first(event_steps(spark, sf_dir)).select(*ID, "n", "event_id")


# ---------------------------------------------------------------- episode filters
@query("success_filter", "SELECT page_id, url FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/success' WHEN 1 THEN '/failure' WHEN 2 THEN '/unsuccessful' ELSE '' END AS url FROM pages) WHERE contains(url, 'success')")
def success_filter(spark, sf_dir):
    ending = F.when(F.col("page_id") % 4 == 0, "/success").when(F.col("page_id") % 4 == 1, "/failure").when(F.col("page_id") % 4 == 2, "/unsuccessful").otherwise("")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("url", ending).alias("url"))
    return P.successful_path(pages, "url")


@query("success_first_row", f"WITH {LINE_STEPS} SELECT s.episode_id, s.t, s.a0 FROM steps s JOIN steps f ON f.episode_id = s.episode_id AND f.t = 0 WHERE f.l_linestatus = 'O'")
def success_first_row(spark, sf_dir):
    return P.episode_flag(line_steps(spark, sf_dir), F.col("l_linestatus") == "O").select(*ID, F.col("action")[0].alias("a0"))


@query("demo_only", f"WITH {LINE_STEPS} SELECT s.episode_id, s.t, s.a0 FROM steps s JOIN steps f ON f.episode_id = s.episode_id AND f.t = f.n - 1 WHERE f.l_linestatus = 'O'")
def demo_only(spark, sf_dir):
    return P.episode_flag(line_steps(spark, sf_dir), F.col("l_linestatus") == "O", last=True).select(*ID, F.col("action")[0].alias("a0"))


@query("skip_unlabeled", f"WITH {LINE_STEPS} SELECT episode_id, t FROM (SELECT *, max((text = 'R')::INT) OVER (PARTITION BY episode_id) AS any_text FROM steps) WHERE any_text = 1")
def skip_unlabeled(spark, sf_dir):
    steps = line_steps(spark, sf_dir).withColumn("language_instruction", F.when(F.col("language_instruction") == "R", "R").otherwise(""))
    return P.any_text(steps).select(*ID)


@query("max_action", f"WITH {EVENT_STEPS} SELECT episode_id, t FROM (SELECT *, max(greatest(abs(a0), abs(a1))) OVER (PARTITION BY episode_id) AS top FROM steps) WHERE top <= 250")
def max_action(spark, sf_dir):
    return P.within_magnitude(event_steps(spark, sf_dir), "action", 250).select(*ID)


@query("max_proprio", f"WITH {EVENT_STEPS} SELECT episode_id, t FROM (SELECT *, max(greatest(abs(a0 / 2), abs(a1))) OVER (PARTITION BY episode_id) AS top FROM steps) WHERE top <= 110")
def max_proprio(spark, sf_dir):
    return P.within_magnitude(event_steps(spark, sf_dir), "proprio", 110).select(*ID)


@query("zero_action", f"""
WITH {LINE_STEPS}, st AS (SELECT avg(a2) AS m2, avg(a3) AS m3, stddev_pop(a2) AS s2, stddev_pop(a3) AS s3 FROM steps)
SELECT episode_id, t FROM steps, st WHERE abs((a2 - m2) / (s2 + 1e-8) - (0 - m2) / (s2 + 1e-8)) > 1e-5 OR abs((a3 - m3) / (s3 + 1e-8) - (0 - m3) / (s3 + 1e-8)) > 1e-5
""")
def zero_action(spark, sf_dir):
    """Discount and tax stand for motion; the zero is normalized by the table's mean and deviation, a one-row join."""
    steps = line_steps(spark, sf_dir).withColumn("m", F.slice("action", 3, 2))
    stats = steps.agg(*[f(F.col("m")[i]).alias(f"{n}{i}") for i in (0, 1) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    joined = steps.join(F.broadcast(stats))
    scaled = F.array(*[(F.col("m")[i] - F.col(f"m{i}")) / (F.col(f"s{i}") + 1e-8) for i in (0, 1)])
    zero = F.array(*[(F.lit(0.0) - F.col(f"m{i}")) / (F.col(f"s{i}") + 1e-8) for i in (0, 1)])
    return P.nonzero_action(joined.withColumn("window", F.array(scaled)).withColumn("zero", zero), F.col("window"), F.col("zero"), 2).select(*ID)


_chunk = f"""
WITH {EVENT_STEPS},
c AS (SELECT s.episode_id, s.t, s.n, unnest(range(0, 4)) AS k FROM steps s),
v AS (SELECT c.episode_id, c.t, c.n, c.k, floor(m.a0 / 60) AS x FROM c JOIN steps m ON m.episode_id = c.episode_id AND m.t = least(c.t + c.k, c.n - 1))
"""


@query("idle_traj", _chunk + """
SELECT s.episode_id, s.t FROM steps s WHERE s.episode_id IN (
  SELECT a.episode_id FROM v a JOIN v b ON b.episode_id = a.episode_id AND b.t = 0 AND b.k = a.k WHERE a.t < 2 AND abs(a.x - b.x) > 1e-3)
""")
def idle_traj(spark, sf_dir):
    steps = event_steps(spark, sf_dir).withColumn("action", F.array(F.floor(F.col("action")[0] / 60).cast("double")))
    return P.idle_filter(W.padded_window(steps, 0, 3, pad="last"), "action_window", 4).select(*ID)


@query("idle_chunk", _chunk + """
SELECT DISTINCT a.episode_id, a.t FROM v a JOIN v b ON b.episode_id = a.episode_id AND b.t = a.t AND b.k = 0 WHERE a.k < 2 AND abs(a.x - b.x) > 1e-3
""")
def idle_chunk(spark, sf_dir):
    steps = event_steps(spark, sf_dir).withColumn("action", F.array(F.floor(F.col("action")[0] / 60).cast("double")))
    return P.idle_filter(W.padded_window(steps, 0, 3, pad="last"), "action_window", 4, mode="chunk").select(*ID)


@query("min_len", f"WITH {LINE_STEPS} SELECT s.episode_id, s.t FROM steps s JOIN steps f ON f.episode_id = s.episode_id AND f.t = 0 WHERE s.n >= 5 AND f.text <> 'N'")
def min_len(spark, sf_dir):
    steps = line_steps(spark, sf_dir).withColumn("language_instruction", F.when(F.col("language_instruction") == "N", " ").otherwise(F.col("language_instruction")))
    return P.at_least(steps, 5).select(*ID)


@query("all_cameras", f"WITH {EMBEDDING_STEPS} SELECT vec_id, traj_id, t FROM views WHERE cameras_avail = 7")
def all_cameras(spark, sf_dir):
    return embedding_steps(spark, sf_dir).where("cameras_avail = 7").select("vec_id", "traj_id", "t")


@query("camera_mask", f"WITH {EMBEDDING_STEPS} SELECT traj_id, bit_or(cameras_avail) AS cameras, count(*) AS n FROM views WHERE vec_id % 3 > 0 GROUP BY traj_id HAVING bit_or(cameras_avail) > 0")
def camera_mask(spark, sf_dir):
    rows = embedding_steps(spark, sf_dir).where("vec_id % 3 > 0")
    return rows.groupBy("traj_id").agg(F.bit_or("cameras_avail").alias("cameras"), F.count(F.lit(1)).alias("n")).where("cameras > 0")


@query("token_range", f"WITH {LINE_STEPS} SELECT episode_id, t FROM steps WHERE 31700 + CAST(a0 AS INT) * 7 BETWEEN 31744 AND 32000 AND 31999 - l_partkey % 300 BETWEEN 31744 AND 32000")
def token_range(spark, sf_dir):
    ids = F.array(F.lit(31700) + F.col("action")[0].cast("int") * 7, F.lit(31999) - F.col("l_partkey") % 300)
    return P.token_range(line_steps(spark, sf_dir).withColumn("ids", ids), "ids").select(*ID)


@query("keep_ranges", f"""
WITH {EVENT_STEPS}, r AS (SELECT DISTINCT episode_id, b AS start, b + 3 + episode_id % 4 AS stop FROM steps, (SELECT unnest([0, 10, 12, 40]) AS b) WHERE episode_id % 5 <> 0)
SELECT s.episode_id, s.t FROM steps s WHERE EXISTS (SELECT 1 FROM r WHERE r.episode_id = s.episode_id AND s.t >= r.start AND s.t < r.stop)
""")
def keep_ranges(spark, sf_dir):
    steps = event_steps(spark, sf_dir).withColumn("episode_key", F.concat(F.lit("user--"), F.col("episode_id").cast("string")))
    ranges = steps.where("episode_id % 5 <> 0").select("episode_key", "episode_id").distinct().select("episode_key", "episode_id", F.explode(F.array(*[F.lit(b) for b in (0, 10, 12, 40)])).alias("start"))
    return P.keep_ranges(steps, ranges.withColumn("end", F.col("start") + 3 + F.col("episode_id") % 4)).select(*ID)


@query("episode_subset", f"WITH {EVENT_STEPS} SELECT episode_id, t FROM steps WHERE episode_id IN (SELECT DISTINCT episode_id FROM steps ORDER BY 1 LIMIT 20)")
def episode_subset(spark, sf_dir):
    return P.episode_subset(event_steps(spark, sf_dir), first=20).select(*ID)


@query("column_compare", f"""
WITH {EVENT_STEPS}
SELECT episode_id, t, TRUE AS same_shape, abs(a1 - a1 * (1 + (t % 3) * 1e-5)) <= 1e-8 + 1e-5 * abs(a1 * (1 + (t % 3) * 1e-5)) AS close, round(abs(a1 - a1 * (1 + (t % 3) * 1e-5)), 9) AS max_diff FROM steps
""")
def column_compare(spark, sf_dir):
    steps = event_steps(spark, sf_dir)
    b = F.array(F.col("action")[0], F.col("action")[1] * (1 + (F.col("t") % 3) * 1e-5))
    rows = P.column_difference(steps.withColumn("b", b), "action", "b")
    return rows.select(*ID, "same_shape", "close", F.round("max_diff", 9).alias("max_diff"))
