"""Queries of statistics, normalization, action tokens, rotations and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import grippers as G
from ..functions import normalize as N
from ..functions import rotations as R
from ..functions import tokens as K
from ..operators import augment, stats
from ..operators import windows as W
from ..sources.steps import EVENT_STEPS, LINE_STEPS, TYPED_STEPS, event_steps, line_steps
from .base import query
from .sequence import ID, flat

TYPED_STATS = TYPED_STEPS + """,
long AS (
  SELECT dataset_name, episode_id, 'action' AS field, d AS dim, CASE d WHEN 0 THEN a0 ELSE a1 END AS x FROM steps, (SELECT unnest([0, 1]) AS d)
  UNION ALL SELECT dataset_name, episode_id, 'proprio', d, CASE d WHEN 0 THEN a1 ELSE a0 / 2 END FROM steps, (SELECT unnest([0, 1]) AS d)),
stats AS (
  SELECT dataset_name, field, CAST(dim AS INT) AS dim, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max,
    quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM long GROUP BY ALL),
wide AS (
  SELECT dataset_name, field, max(mean) FILTER (dim = 0) AS m0, max(mean) FILTER (dim = 1) AS m1, max(std) FILTER (dim = 0) AS s0, max(std) FILTER (dim = 1) AS s1,
    max(q01) FILTER (dim = 0) AS l0, max(q01) FILTER (dim = 1) AS l1, max(q99) FILTER (dim = 0) AS h0, max(q99) FILTER (dim = 1) AS h1,
    max(min) FILTER (dim = 0) AS n0, max(min) FILTER (dim = 1) AS n1, max(max) FILTER (dim = 0) AS x0, max(max) FILTER (dim = 1) AS x1 FROM stats GROUP BY ALL)
"""


@query("dataset_stats", f"""
WITH {TYPED_STATS}, sizes AS (SELECT dataset_name, count(*) AS num_transitions, count(DISTINCT episode_id) AS num_trajectories FROM steps GROUP BY 1)
SELECT dataset_name, field, dim, round(mean, 6) AS mean, round(std, 6) AS std, min, max, round(q01, 6) AS q01, round(q99, 6) AS q99, num_transitions, num_trajectories FROM stats JOIN sizes USING (dataset_name)
""")
def dataset_stats(spark, sf_dir):
    out = stats.dataset_statistics(event_steps(spark, sf_dir, by_type=True))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q01", "q99")})


@query("running_stats", f"""
WITH {LINE_STEPS}, long AS (SELECT CAST(d AS INT) AS dim, CASE d WHEN 0 THEN a0 WHEN 1 THEN a2 ELSE a3 END AS x FROM steps, (SELECT unnest([0, 1, 2]) AS d))
SELECT dim, count(*) AS n, round(avg(x), 6) AS mean, round(sqrt(greatest(0, avg(x * x) - avg(x) * avg(x))), 6) AS std FROM long GROUP BY dim
""")
def running_stats(spark, sf_dir):
    steps = line_steps(spark, sf_dir).select(F.array(*[F.col("action")[i] for i in (0, 2, 3)]).alias("v"))
    return stats.running_statistics(steps, "v").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("hist_quantiles", f"""
WITH {LINE_STEPS}, span AS (SELECT min(a1) AS lo, max(a1) AS hi, count(*) AS total FROM steps),
bins AS (SELECT least(floor((a1 - lo) / ((hi - lo) / 5000)), 4999) AS bin, count(*) AS c, any_value(lo) AS lo, any_value(hi) AS hi, any_value(total) AS n FROM steps, span GROUP BY 1),
through AS (SELECT *, sum(c) OVER (ORDER BY bin) AS s FROM bins)
SELECT CAST(0 AS INT) AS dim, q, round(min(lo + bin * ((hi - lo) / 5000)), 4) AS value FROM through, (SELECT unnest([0.01, 0.5, 0.99]::DOUBLE[]) AS q) WHERE s >= q * n GROUP BY q
""")
def hist_quantiles(spark, sf_dir):
    steps = line_steps(spark, sf_dir).select(F.array(F.col("action")[1]).alias("v"))
    return stats.histogram_quantiles(steps, "v", [0.01, 0.5, 0.99]).withColumn("value", F.round("value", 4))


_BUCKETS = """
b AS (SELECT CAST(sign(a1) AS INT) AS sign, CASE WHEN a1 = 0 THEN 0 ELSE CAST(ceil(ln(abs(a1)) / ln(1.001 / 0.999)) AS INT) END AS bucket, count(*) AS c FROM steps GROUP BY ALL),
t AS (SELECT *, sum(c) OVER (ORDER BY sign, sign * bucket) AS through FROM b),
q AS (SELECT share, max(sign * pow(1.001 / 0.999, bucket::DOUBLE) * (2 / (1.001 / 0.999 + 1))) AS value FROM t, (SELECT unnest([0.01, 0.5, 0.99]::DOUBLE[]) AS share)
  WHERE through > floor(share * ((SELECT count(*) FROM steps) - 1)) AND through - c <= floor(share * ((SELECT count(*) FROM steps) - 1)) GROUP BY share)"""


@query("merged_stats", f"""
WITH {LINE_STEPS}, {_BUCKETS}
SELECT CAST(0 AS INT) AS dim, count(*) AS n, round(avg(a1), 4) AS mean, round(stddev_pop(a1), 4) AS std, min(a1) AS min, max(a1) AS max,
  (SELECT round(least(greatest(value, min(a1)), max(a1)), 4) FROM q WHERE share = 0.01) AS q01, (SELECT round(value, 4) FROM q WHERE share = 0.5) AS q50, (SELECT round(least(greatest(value, min(a1)), max(a1)), 4) FROM q WHERE share = 0.99) AS q99 FROM steps
""")
def merged_stats(spark, sf_dir):
    """Statistics of one return flag's shards, then of all: the second run reads only shards that are new, and merges."""
    from ..sources.storage import scratch

    folder = scratch(spark)
    steps = line_steps(spark, sf_dir).select(F.concat("l_returnflag", "l_linestatus").alias("shard"), F.array(F.col("action")[1]).alias("v"))
    stats.update_statistics(steps.where("shard LIKE 'R%'"), "v", "shard", folder)
    stats.update_statistics(steps, "v", "shard", folder)
    out = stats.stored_statistics(spark, folder, [0.01, 0.5, 0.99])
    return out.select("dim", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", "max", *[F.round(F.col("quantiles")[i], 4).alias(c) for i, c in enumerate(("q01", "q50", "q99"))])


@query("norm_stats_job", f"WITH {LINE_STEPS} SELECT CAST(0 AS INT) AS dim, count(*) AS n, round(avg(a0), 6) AS mean, round(sqrt(greatest(0, avg(a0 * a0) - avg(a0) * avg(a0))), 6) AS std FROM steps")
def norm_stats_job(spark, sf_dir):
    """Statistics of all steps; a job that takes one row in n filters its steps before."""
    steps = line_steps(spark, sf_dir).select(F.array(F.col("action")[0]).alias("v"))
    return stats.running_statistics(steps, "v").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def normalized(spark, sf_dir, f, field="action"):
    steps = event_steps(spark, sf_dir, by_type=True)
    arrays = stats.statistics_arrays(stats.dataset_statistics(steps), field)
    mask = A.literal_mask([True, False])
    rows = stats.with_statistics(steps, arrays).withColumn("y", f(mask))
    return rows.select("dataset_name", *ID, F.round(F.col("y")[0], 6).alias("y0"), F.round(F.col("y")[1], 6).alias("y1"))


def normalized_sql(y0: str, y1: str, field: str = "action") -> str:
    return f"WITH {TYPED_STATS} SELECT s.dataset_name, s.episode_id, s.t, round({y0}, 6) AS y0, round({y1}, 6) AS y1 FROM steps s JOIN wide w ON w.dataset_name = s.dataset_name AND w.field = '{field}'"


@query("norm_zscore", normalized_sql("(a0 - m0) / (s0 + 1e-8)", "a1"))
def norm_zscore(spark, sf_dir):
    return normalized(spark, sf_dir, lambda m: N.z_score(F.col("action"), F.col("mean"), F.col("std"), m))


@query("norm_bounds", normalized_sql("greatest(-1.0, least(1.0, 2 * (a0 - n0) / (w.x0 - n0 + 1e-8) - 1))", "a1"))
def norm_bounds(spark, sf_dir):
    return normalized(spark, sf_dir, lambda m: N.to_bounds(F.col("action"), F.col("min"), F.col("max"), m))


@query("norm_q99", normalized_sql("greatest(-1.0, least(1.0, 2 * (a0 - l0) / (h0 - l0 + 1e-8) - 1))", "a1"))
def norm_q99(spark, sf_dir):
    return normalized(spark, sf_dir, lambda m: N.to_bounds(F.col("action"), F.col("q01"), F.col("q99"), m))


@query("norm_openpi", normalized_sql("(a0 - l0) / (h0 - l0 + 1e-6) * 2 - 1", "(a1 - l1) / (h1 - l1 + 1e-6) * 2 - 1"))
def norm_openpi(spark, sf_dir):
    return normalized(spark, sf_dir, lambda m: N.to_quantiles(F.col("action"), F.col("q01"), F.col("q99"), A.literal_mask([True, True])))


@query("unnormalize", normalized_sql("(a1 + 1) / 2 * (h0 - l0 + 1e-6) + l0", "0.5 * (a1 + 1) * (h1 - l1) + l1"))
def unnormalize(spark, sf_dir):
    y = F.array(F.col("action")[1], F.col("action")[1])
    one = lambda m: N.from_quantiles(y, F.col("q01"), F.col("q99"), m)
    two = lambda m: N.from_bounds(y, F.col("q01"), F.col("q99"), A.literal_mask([False, True]))
    return normalized(spark, sf_dir, lambda m: F.array(one(m)[0], two(m)[1]))


@query("norm_proprio", normalized_sql("greatest(-1.0, least(1.0, 2 * (a1 - l0) / (h0 - l0 + 1e-8) - 1))", "greatest(-1.0, least(1.0, a0 / 2))", "proprio"))
def norm_proprio(spark, sf_dir):
    return normalized(spark, sf_dir, lambda m: N.proprio_bounds(F.col("proprio"), F.col("q01"), F.col("q99"), m), "proprio")


@query("unnorm_key_check", f"WITH {TYPED_STEPS} SELECT DISTINCT dataset_name FROM steps WHERE dataset_name NOT IN ('view', 'click')")
def unnorm_key_check(spark, sf_dir):
    """Datasets of the steps that have no statistics; the operator `require_known` raises for them."""
    steps = event_steps(spark, sf_dir, by_type=True)
    return stats.unknown_datasets(steps, stats.dataset_statistics(steps.where(F.col("dataset_name").isin("view", "click"))).select("dataset_name").distinct())


_deltas = f"""
WITH {EVENT_STEPS}, places AS (SELECT s.*, unnest(range(0, 3)) AS o FROM steps s)
SELECT p.episode_id, p.t, CAST(p.o AS INT) AS k, round(m.a0 {{sign}} p.a1, 6) AS x0, round(m.a1, 6) AS x1
FROM places p JOIN steps m ON m.episode_id = p.episode_id AND m.t = least(p.t + p.o, p.n - 1)
"""


def _shifted(spark, sf_dir, sign):
    chunks = W.padded_window(event_steps(spark, sf_dir), 0, 2, pad="last")
    rows = chunks.withColumn("y", N.shifted(F.col("action_window"), F.col("proprio"), A.literal_mask(A.bool_mask(1, -1)), sign))
    return flat(rows, "y", ID)


@query("delta_actions", _deltas.format(sign="-"))
def delta_actions(spark, sf_dir):
    return _shifted(spark, sf_dir, -1)


@query("absolute_actions", _deltas.format(sign="+"))
def absolute_actions(spark, sf_dir):
    return _shifted(spark, sf_dir, 1)


@query("delta_per_step", f"WITH {EVENT_STEPS} SELECT episode_id, t, round(a0 - a1, 6) AS x0, round(a1 - a0 / 2, 6) AS x1 FROM steps")
def delta_per_step(spark, sf_dir):
    d = A.minus(F.col("action"), F.col("proprio"))
    return event_steps(spark, sf_dir).select(*ID, F.round(d[0], 6).alias("x0"), F.round(d[1], 6).alias("x1"))


@query("norm_droid", f"WITH {EVENT_STEPS} SELECT episode_id, t, round(greatest(-1.0, least(1.0, (a0 - 5.0) / (120.0 - 5.0) * 2 - 1)), 6) AS x0, CASE WHEN a1 >= 0.5 THEN 1.0 ELSE 0.0 END AS x1 FROM steps")
def norm_droid(spark, sf_dir):
    y = N.droid_actions(F.col("action"), A.vector([5.0]), A.vector([120.0]))
    return event_steps(spark, sf_dir).select(*ID, F.round(y[0], 6).alias("x0"), y[1].alias("x1"))


@query("gripper_sign", f"WITH {EVENT_STEPS} SELECT episode_id, t, CAST(sign(2 * a1 - 1) AS DOUBLE) AS signed, round(1 - a1, 6) AS inverted, CASE WHEN a1 - 0.3 > 0 THEN 1.0 ELSE -1.0 END AS thresholded FROM steps")
def gripper_sign(spark, sf_dir):
    g = F.col("action")[1]
    return event_steps(spark, sf_dir).select(*ID, G.to_signed(g).alias("signed"), F.round(G.inverted(g), 6).alias("inverted"), G.thresholded(g - 0.3).alias("thresholded"))


@query("aloha_frames", f"""
WITH {EVENT_STEPS}, m AS (SELECT *, a1 * (0.058 - 0.01844) + 0.01844 AS lin FROM steps)
SELECT episode_id, t, round((asin(greatest(-1.0, least(1.0, (0.022 * 0.022 - 0.036 * 0.036 + lin * lin) / (2 * 0.022 * lin)))) - 0.4) / 1.1, 6) AS angular,
  round((a1 * 1.1 + 0.4 + 0.6213) / 2.1123, 6) AS commanded, round((a1 * 2.1123 - 0.6213 - 0.4) / 1.1, 6) AS back, round(-a0, 6) AS joint1, a0 AS joint6 FROM m
""")
def aloha_frames(spark, sf_dir):
    g = F.col("action")[1]
    joints = G.flipped_joints(F.array_repeat(F.col("action")[0], 14))
    rows = event_steps(spark, sf_dir).withColumn("j", joints)
    return rows.select(*ID, F.round(G.linear_to_angular(g), 6).alias("angular"), F.round(G.angular_to_commanded(g), 6).alias("commanded"), F.round(G.commanded_to_angular(g), 6).alias("back"), F.round(F.col("j")[1], 6).alias("joint1"), F.col("j")[6].alias("joint6"))


# ---------------------------------------------------------------- tokens
def _edges(bins: int) -> str:
    return "[" + ", ".join(repr(x) for x in K.edges(bins)) + "]::DOUBLE[]"


_unit = "greatest(-1.0, least(1.0, a1 * 3 - 1.2))"


@query("action_tokens", f"WITH {EVENT_STEPS}, e AS (SELECT {_edges(256)} AS es, {_edges(512)} AS fs) SELECT episode_id, t, CAST(32000 - len(list_filter(es, lambda x: x <= {_unit})) AS INT) AS id256, CAST(31000 - len(list_filter(fs, lambda x: x <= {_unit})) AS INT) AS id512 FROM steps, e")
def action_tokens(spark, sf_dir):
    x = F.array(F.col("action")[1] * 3 - 1.2)
    return event_steps(spark, sf_dir).select(*ID, K.token_ids(x)[0].alias("id256"), K.token_ids(x, 32000, 512, 1000)[0].alias("id512"))


@query("token_decode", f"WITH {EVENT_STEPS}, e AS (SELECT {_edges(256)} AS es) SELECT episode_id, t, round((es[i + 1] + es[i + 2]) / 2, 6) AS x FROM (SELECT *, greatest(0, least(254, 32000 - CAST(31740 + t * 4 AS INT) - 1)) AS i FROM steps, e)")
def token_decode(spark, sf_dir):
    ids = F.array((F.lit(31740) + F.col("t") * 4).cast("int"))
    return event_steps(spark, sf_dir).select(*ID, F.round(K.decode_ids(ids)[0], 6).alias("x"))


@query("token_convert", f"""
WITH {EVENT_STEPS}, e AS (SELECT {_edges(256)} AS es), v AS (SELECT *, greatest(-1.0, least(1.0, (a0 - 2.0) / 98.0 * 2 - 1)) AS u FROM steps, e),
c AS (SELECT episode_id, t, i, abs((es[i + 1] + es[i + 2]) / 2 - u) AS d FROM v, (SELECT unnest(range(0, 255)) AS i))
SELECT episode_id, t, CAST(31999 - min_by(i, (round(d, 9), i)) AS INT) AS id FROM c GROUP BY ALL
""")
def token_convert(spark, sf_dir):
    return event_steps(spark, sf_dir).select(*ID, K.nearest_id(F.col("action")[0], F.lit(2.0), F.lit(100.0)).alias("id"))


@query("state_prompt", f"""
WITH {EVENT_STEPS}, e AS (SELECT {_edges(257)} AS es)
SELECT episode_id, t, 'Task: ' || lower(text) || ', State: ' || CAST(least(len(list_filter(es, lambda x: x <= greatest(-1.0, least(1.0, a1 * 3 - 1.2)))), 257) - 1 AS VARCHAR) || ';' || chr(10) AS prompt FROM steps, e
""")
def state_prompt(spark, sf_dir):
    return event_steps(spark, sf_dir).select(*ID, K.state_prompt(F.col("language_instruction"), F.array(F.col("action")[1] * 3 - 1.2)).alias("prompt"))


# ---------------------------------------------------------------- rotations and augmentation
_q = "(SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w, sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2 + embedding[4]::DOUBLE ** 2) AS n FROM embeddings)"
_uq = f"(SELECT vec_id, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM {_q})"


@query("quat_to_axis", f"SELECT vec_id, round(x * 2 * acos(w) / sqrt(1 - w * w), 6) AS ax, round(y * 2 * acos(w) / sqrt(1 - w * w), 6) AS ay, round(z * 2 * acos(w) / sqrt(1 - w * w), 6) AS az, round(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), 6) AS roll, round(asin(greatest(-1.0, least(1.0, 2 * (w * y - z * x)))), 6) AS pitch, round(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)), 6) AS yaw FROM {_uq}")
def quat_to_axis(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", R.unit(F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))).alias("q"))
    rows = e.withColumns({"a": R.quaternion_to_axis_angle(F.col("q")), "r": R.quaternion_to_euler(F.col("q"))})
    return rows.select("vec_id", *[F.round(F.col("a")[i], 6).alias(n) for i, n in enumerate(("ax", "ay", "az"))], *[F.round(F.col("r")[i], 6).alias(n) for i, n in enumerate(("roll", "pitch", "yaw"))])


@query("negative_actions", f"""
WITH {EVENT_STEPS}, places AS (SELECT s.*, unnest(range(-2, 1)) AS o FROM steps s)
SELECT p.episode_id, p.t, CAST(o + 2 AS INT) AS k, CASE WHEN m.t IS NULL THEN -5.0 ELSE round(m.a0 + CASE WHEN p.event_id % 2 = 0 THEN 0.1 ELSE -0.1 END, 6) END AS x0, CASE WHEN m.t IS NULL THEN -5.0 ELSE round(-m.a1, 6) END AS x1
FROM places p LEFT JOIN steps m ON m.episode_id = p.episode_id AND m.t = p.t + p.o
""")
def negative_actions(spark, sf_dir):
    windows = W.padded_window(event_steps(spark, sf_dir), 2, 0)
    return flat(windows.withColumn("neg", augment.negative_actions(F.col("action_window"), F.col("event_id"), 0.1)), "neg", ID)


@query("gaussian_augment")
def gaussian_augment(spark, sf_dir):
    steps = line_steps(spark, sf_dir).withColumn("a", F.array(F.col("action")[2] * 10, F.col("action")[3] * 10, F.col("action")[2] * 10))
    rows = augment.gaussian_samples(steps, ["l_returnflag"], "a", 16)
    return rows.select("l_returnflag", "sample", *[F.round(F.col("a")[i], 9).alias(f"x{i}") for i in range(3)])


@query("policy_inputs", f"WITH {EVENT_STEPS} SELECT episode_id, t, round(a1, 6) AS s0, round(a0 / 2, 6) AS s1, 0.0 AS s7, TRUE AS base_mask, text <> 'error' AS left_mask, FALSE AS right_mask FROM steps")
def policy_inputs(spark, sf_dir):
    """State padded to eight dims; camera slots are filled where a view is there."""
    from ..operators.standardize import policy_inputs as inputs

    steps = event_steps(spark, sf_dir).withColumns({"base": F.lit("img"), "left": F.when(F.col("language_instruction") != "error", "img")})
    rows = inputs(steps, [F.col("proprio")], {"base": "base", "left": "left", "right": None}, 8)
    return rows.select(*ID, F.round(F.col("state")[0], 6).alias("s0"), F.round(F.col("state")[1], 6).alias("s1"), F.col("state")[7].alias("s7"), "base_mask", "left_mask", "right_mask")


@query("pad_to_dim", f"WITH {EVENT_STEPS} SELECT episode_id, t, a0 AS x0, 0.0 AS x3, a0 AS short0, CAST(4 AS INT) AS n FROM steps")
def pad_to_dim(spark, sf_dir):
    long = A.pad_to(F.col("action"), 4)
    return event_steps(spark, sf_dir).select(*ID, long[0].alias("x0"), long[3].alias("x3"), A.pad_to(F.col("action"), 1)[0].alias("short0"), F.size(long).alias("n"))


@query("clip_actions", f"WITH {EVENT_STEPS} SELECT episode_id, t, greatest(-1.0, least(1.0, a0)) AS x0, a1 AS x1 FROM steps")
def clip_actions(spark, sf_dir):
    y = A.clip(F.col("action"), -1, 1)
    return event_steps(spark, sf_dir).select(*ID, y[0].alias("x0"), y[1].alias("x1"))


@query("stride_actions", f"WITH {EVENT_STEPS}, p AS (SELECT s.*, unnest([0, 3]) AS o FROM steps s) SELECT p.episode_id, p.t, CAST(p.o // 3 AS INT) AS k, m.a0 AS x0 FROM p JOIN steps m ON m.episode_id = p.episode_id AND m.t = least(p.t + p.o, p.n - 1)")
def stride_actions(spark, sf_dir):
    chunks = W.padded_window(event_steps(spark, sf_dir), 0, 4, pad="last").withColumn("s", A.stride(F.col("action_window"), 3))
    return chunks.select(*ID, F.posexplode("s").alias("k", "a")).select(*ID, "k", F.col("a")[0].alias("x0"))


@query("stats_cache", f"WITH {TYPED_STATS}, sizes AS (SELECT dataset_name, count(*) AS num_transitions FROM steps GROUP BY 1) SELECT dataset_name, field, dim, round(mean, 6) AS mean, num_transitions FROM stats JOIN sizes USING (dataset_name)")
def stats_cache(spark, sf_dir):
    """Statistics written under their key on the first read and read back on the second; a new folder for each run."""
    from ..sources.storage import scratch

    folder = scratch(spark)
    steps = event_steps(spark, sf_dir, by_type=True)
    stats.cached_statistics(steps, folder, "events", {"by": "type"})
    again = stats.cached_statistics(steps, folder, "events", {"by": "type"})
    return again.select("dataset_name", "field", "dim", F.round("mean", 6).alias("mean"), "num_transitions")


@query("stats_json")
def stats_json(spark, sf_dir):
    return stats.statistics_json(stats.dataset_statistics(event_steps(spark, sf_dir, by_type=True)))
