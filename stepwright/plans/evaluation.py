"""Queries of rollout, score, agreement and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.keyed import draw_sql
from ..operators import metrics as M
from ..operators import retrieval as R
from ..sources.steps import EMBEDDING_STEPS, EVENT_STEPS, LINE_STEPS, ROLLOUTS, embedding_steps, event_steps, line_steps, rollouts, table
from .base import query


def rounded(df, places=6, but=()):
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double" and c not in but})


def frames(spark, sf_dir):
    return event_steps(spark, sf_dir).select("episode_id", "t", "n", "event_type", F.col("action")[0].alias("score"), F.col("action")[1].alias("k"))


@query("episode_scores", f"""
WITH {EVENT_STEPS}, p AS (SELECT episode_id, avg(a0) AS m FROM steps GROUP BY 1)
SELECT round(avg(m), 6) AS episode_mean, round(stddev_pop(m), 6) AS episode_std, round(min(m), 6) AS episode_min, round(max(m), 6) AS episode_max, round(quantile_cont(m, 0.5), 6) AS episode_median, count(*) AS episodes,
 (SELECT round(avg(a0), 6) FROM steps) AS frame_mean, (SELECT round(stddev_pop(a0), 6) FROM steps) AS frame_std FROM p
""")
def episode_scores(spark, sf_dir):
    return rounded(M.overall_scores(frames(spark, sf_dir)))


@query("per_episode_scores", f"WITH {EVENT_STEPS} SELECT episode_id, round(avg(a0), 6) AS mean, round(stddev_pop(a0), 6) AS std, min(a0) AS min, max(a0) AS max, count(*) AS length FROM steps GROUP BY 1")
def per_episode_scores(spark, sf_dir):
    return rounded(M.episode_scores(frames(spark, sf_dir)))


@query("score_percentiles", f"WITH {EVENT_STEPS}, p AS (SELECT avg(a0) AS m FROM steps GROUP BY episode_id) SELECT q AS share, round(quantile_cont(m, q), 6) AS value FROM p, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS q) GROUP BY q".replace("quantile_cont(m, q)", "list_sort(list(m))[CAST(floor(q * (count(*) - 1)) AS INT) + 1] + (q * (count(*) - 1) - floor(q * (count(*) - 1))) * (list_sort(list(m))[CAST(ceil(q * (count(*) - 1)) AS INT) + 1] - list_sort(list(m))[CAST(floor(q * (count(*) - 1)) AS INT) + 1])"))
def score_percentiles(spark, sf_dir):
    return rounded(M.score_percentiles(M.episode_scores(frames(spark, sf_dir)), "mean", [0.1, 0.25, 0.5, 0.75, 0.9]), but=("share",))


@query("top_bottom", f"WITH {EVENT_STEPS}, p AS (SELECT episode_id, round(avg(a0), 6) AS mean FROM steps GROUP BY 1) (SELECT * FROM p ORDER BY mean DESC, episode_id LIMIT 5) UNION (SELECT * FROM p ORDER BY mean, episode_id LIMIT 5)")
def top_bottom(spark, sf_dir):
    per = rounded(M.episode_scores(frames(spark, sf_dir))).select("episode_id", "mean")
    return M.top_and_bottom(per, "mean", 5, "episode_id")


_summary = ROLLOUTS + """,
means AS (SELECT episode_id, any_value(condition) AS condition, avg(nullif(score, 0)) AS m FROM rollout_steps GROUP BY 1),
summary AS (
  SELECT condition, count(*) AS total, CAST(sum(success) AS BIGINT) AS successes, avg(success) AS rate, avg(m) FILTER (success = 1) AS success_score, avg(m) FILTER (success = 0) AS failure_score, stddev_pop(m) AS score_std, avg(m) AS score_mean
  FROM means JOIN rollouts USING (episode_id, condition) GROUP BY 1)
"""


@query("rollout_summary", f"WITH {_summary} SELECT condition, total, successes, round(rate, 6) AS rate, round(success_score, 6) AS success_score, round(failure_score, 6) AS failure_score, round(score_std, 6) AS score_std, round(score_mean, 6) AS score_mean FROM summary")
def rollout_summary(spark, sf_dir):
    return rounded(M.rollout_summary(rollouts(spark, sf_dir)))


@query("rate_vs_score", f"WITH {_summary} SELECT condition, round(rate, 6) AS rate, round((coalesce(success_score * successes, 0) + coalesce(failure_score * (total - successes), 0)) / total, 6) AS score FROM summary")
def rate_vs_score(spark, sf_dir):
    return rounded(M.rate_vs_score(M.rollout_summary(rollouts(spark, sf_dir))))


@query("task_rephrase_rate", f"WITH {ROLLOUTS} SELECT CAST(regexp_extract(condition, 'rephrase_([0-9]+)', 1) AS INT) AS rephrases, episode_id % 5 AS task, count(*) AS n, round(avg(success), 6) AS rate FROM rollouts GROUP BY ALL")
def task_rephrase_rate(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    count = F.when(F.col("condition") == "no_transform_1", 0).otherwise(F.regexp_extract("condition", r"rephrase_(\d+)", 1).cast("int"))
    return rounded(r.groupBy(count.alias("rephrases"), (F.col("episode_id") % 5).alias("task")).agg(F.count(F.lit(1)).alias("n"), F.avg("success").alias("rate")))


def rollout_frames(spark, sf_dir):
    return rollouts(spark, sf_dir).select("episode_id", "condition", "success", F.posexplode("score_list").alias("t", "score"))


@query("task_score_series", f"WITH {ROLLOUTS} SELECT condition, episode_id % 5 AS task, t, count(nullif(score, 0)) AS n, round(avg(nullif(score, 0)), 6) AS mean FROM rollout_steps GROUP BY ALL")
def task_score_series(spark, sf_dir):
    rows = rollout_frames(spark, sf_dir).withColumn("task", F.col("episode_id") % 5)
    return rounded(M.score_series(rows, M.missing_zero(F.col("score")), ["condition", "task"])).select("condition", "task", "t", "n", "mean")


@query("score_series", f"WITH {ROLLOUTS}, s AS (SELECT r.success, s.t, nullif(s.score, 0) AS v FROM rollout_steps s JOIN rollouts r USING (episode_id)) SELECT success, t, count(v) AS n, round(avg(v), 6) AS mean, CASE WHEN count(v) > 1 THEN round(stddev_pop(v), 6) END AS std FROM s GROUP BY ALL")
def score_series(spark, sf_dir):
    return rounded(M.score_series(rollout_frames(spark, sf_dir), M.missing_zero(F.col("score")), ["success"]))


@query("norm_series", f"WITH {ROLLOUTS}, s AS (SELECT r.success, s.t, sqrt(a0 * a0 + a1 * a1) AS v FROM rollout_steps s JOIN rollouts r USING (episode_id)) SELECT success, t, count(v) AS n, round(avg(v), 6) AS mean, CASE WHEN count(v) > 1 THEN round(stddev_pop(v), 6) END AS std FROM s GROUP BY ALL")
def norm_series(spark, sf_dir):
    """Norms of the actions by timestep and outcome."""
    steps = event_steps(spark, sf_dir).join(rollouts(spark, sf_dir).select("episode_id", "success"), "episode_id")
    return rounded(M.score_series(steps, A.norm(F.col("action")), ["success"]))


_distance = ROLLOUTS + ", d AS (SELECT r.episode_id, r.success, r.n, avg(s.a1) AS distance, avg(nullif(s.score, 0)) AS m, r.condition FROM rollouts r JOIN rollout_steps s USING (episode_id) GROUP BY ALL)"


def distances(spark, sf_dir):
    k = event_steps(spark, sf_dir).groupBy("episode_id").agg(F.avg(F.col("action")[1]).alias("distance"), F.avg(F.when((F.col("event_type") != "error") & (F.col("action")[0] != 0), F.col("action")[0])).alias("m"))
    return rollouts(spark, sf_dir).select("episode_id", "condition", "success", "n").join(k, "episode_id")


@query("binned_success", f"""
WITH {_distance}, s AS (SELECT min(distance) AS lo, max(distance) AS hi FROM d),
b AS (SELECT CAST(least(floor((distance - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin, count(*) AS n, avg(success) AS rate FROM d, s GROUP BY 1),
f AS (SELECT regr_slope(rate, bin) AS slope, regr_intercept(rate, bin) AS intercept FROM b)
SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, round(coalesce(rate, 0), 6) AS rate, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM (SELECT unnest(range(0, 10)) AS i) LEFT JOIN b ON b.bin = i, f
""")
def binned_success(spark, sf_dir):
    return rounded(M.binned_rate(distances(spark, sf_dir), "distance", "success"))


@query("distance_corr", f"WITH {_distance} SELECT round(corr(distance, success), 6) AS r FROM d")
def distance_corr(spark, sf_dir):
    return distances(spark, sf_dir).agg(F.round(F.corr("distance", F.col("success").cast("double")), 6).alias("r"))


@query("score_length_fit", f"WITH {_distance} SELECT condition, round(regr_slope(n, m), 6) AS slope, round(regr_intercept(n, m), 6) AS intercept FROM d GROUP BY 1")
def score_length_fit(spark, sf_dir):
    rows = distances(spark, sf_dir).groupBy("condition")
    n = F.col("n").cast("double")
    return rows.agg(F.round(F.regr_slope(n, F.col("m")), 6).alias("slope"), F.round(F.regr_intercept(n, F.col("m")), 6).alias("intercept"))


@query("instr_distance", f"WITH {EVENT_STEPS} SELECT episode_id, round(avg(CASE WHEN text = 'error' THEN 1.0 ELSE 1 - a1 END), 6) AS distance FROM steps GROUP BY 1")
def instr_distance(spark, sf_dir):
    """Mean of 1 - similarity; a blank instruction is at distance 1."""
    d = F.when(F.col("event_type") == "error", 1.0).otherwise(F.lit(1.0) - F.col("action")[1])
    return event_steps(spark, sf_dir).groupBy("episode_id").agg(F.round(F.avg(d), 6).alias("distance"))


_policies = """
p AS (
  SELECT r_name AS task, n_name AS policy, avg(c_acctbal) AS sim, avg(s.bal) AS real, count(*) AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey
  JOIN (SELECT s_nationkey, avg(s_acctbal) AS bal FROM supplier GROUP BY 1) s ON s.s_nationkey = n_nationkey GROUP BY ALL)
"""


def policies(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.avg("s_acctbal").alias("real"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("sim"), F.count(F.lit(1)).alias("n"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(c, "n_nationkey").join(s, "n_nationkey").select(F.col("r_name").alias("task"), F.col("n_name").alias("policy"), "sim", "real", "n")


@query("pearson", f"WITH {_policies}, m AS (SELECT *, sim - avg(sim) OVER (PARTITION BY task) AS a, real - avg(real) OVER (PARTITION BY task) AS b FROM p) SELECT task, CASE WHEN max(abs(a - b)) < 1e-12 THEN 1.0 ELSE round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)) + 1e-8), 6) END AS pearson FROM m GROUP BY 1")
def pearson(spark, sf_dir):
    return rounded(M.pearson(policies(spark, sf_dir), "sim", "real", ["task"]))


@query("mmrv", f"WITH {_policies}, w AS (SELECT a.task, a.policy, max(CASE WHEN (a.sim > b.sim) <> (a.real > b.real) THEN abs(a.real - b.real) ELSE 0 END) AS worst FROM p a JOIN p b ON a.task = b.task GROUP BY ALL) SELECT task, round(avg(worst), 4) AS mmrv FROM w GROUP BY 1")
def mmrv(spark, sf_dir):
    return rounded(M.mean_maximum_rank_violation(policies(spark, sf_dir), "sim", "real", ["task"], "policy"), 4)


@query("kruskal_h", f"""
WITH {ROLLOUTS}, tr AS (SELECT condition, CASE WHEN episode_id % 2 = 0 THEN 'sim' ELSE 'real' END AS g, success AS x FROM rollouts), tr2 AS (SELECT *, episode_id AS e FROM rollouts),
tt AS (SELECT CAST(e % 3 AS INT) AS task, CASE WHEN e % 2 = 0 THEN 'sim' ELSE 'real' END AS g, success AS x FROM tr2),
v AS (SELECT task, x, count(*) AS t FROM tt GROUP BY ALL),
k AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY task ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS mid FROM v),
r AS (SELECT tt.task, g, sum(mid)::DOUBLE AS r, count(*)::DOUBLE AS n FROM tt JOIN k ON k.task = tt.task AND k.x = tt.x GROUP BY ALL),
s AS (SELECT task, sum(r * r / n) AS s, sum(n) AS n FROM r GROUP BY 1), c AS (SELECT task, sum(t * t * t - t)::DOUBLE AS tied FROM k GROUP BY 1)
SELECT task, round((12 * s / (n * (n + 1)) - 3 * (n + 1)) / (1 - tied / (n * n * n - n)), 6) AS h FROM s JOIN c USING (task)
""")
def kruskal_h(spark, sf_dir):
    t = rollouts(spark, sf_dir).select((F.col("episode_id") % 3).cast("int").alias("task"), F.when(F.col("episode_id") % 2 == 0, "sim").otherwise("real").alias("g"), "success")
    return rounded(M.kruskal_h(t, ["task"], "g", "success"))


@query("kruskal_p")
def kruskal_p(spark, sf_dir):
    """The same with p values; trials are rebuilt from rates and counts first."""
    rates = rollouts(spark, sf_dir).groupBy((F.col("episode_id") % 3).cast("int").alias("task"), F.when(F.col("episode_id") % 2 == 0, "sim").otherwise("real").alias("g")).agg(F.avg("success").alias("rate"), F.count(F.lit(1)).cast("int").alias("trials"))
    h = M.kruskal_h(M.rebuilt_trials(rates, "trials", "rate"), ["task"], "g", "outcome")
    return rounded(h.withColumn("p", M.chi2_tail(F.col("h"))))


@query("mean_of_means", f"WITH {LINE_STEPS}, a AS (SELECT l_returnflag AS task, CAST(a0 AS BIGINT) % 4 AS orientation, l_partkey % 5 AS variant, avg((l_linestatus = 'O')::INT) AS r FROM steps GROUP BY ALL), b AS (SELECT task, orientation, avg(r) AS r FROM a GROUP BY ALL) SELECT task, round(avg(r), 6) AS rate FROM b GROUP BY 1")
def mean_of_means(spark, sf_dir):
    rows = line_steps(spark, sf_dir).select(F.col("l_returnflag").alias("task"), (F.col("action")[0].cast("long") % 4).alias("orientation"), (F.col("l_partkey") % 5).alias("variant"), "l_linestatus")
    return rounded(M.mean_of_means(rows, (F.col("l_linestatus") == "O").cast("double"), [["task", "orientation", "variant"], ["task", "orientation"], ["task"]]))


@query("token_accuracy", f"""
WITH {LINE_STEPS}, m AS (SELECT episode_id, t, CASE WHEN l_partkey % 5 = 0 THEN -100 ELSE CAST(a0 AS INT) END AS truth, CASE WHEN l_partkey % 3 = 0 THEN CAST(a0 AS INT) ELSE 7 END AS guess FROM steps),
p AS (SELECT *, sum((truth <> -100)::INT) OVER (PARTITION BY episode_id ORDER BY t) AS place FROM m)
SELECT episode_id, round(avg((guess = truth)::INT) FILTER (place <= 2), 6) AS current_accuracy, round(avg((guess = truth)::INT) FILTER (place > 2), 6) AS next_accuracy, count(*) AS n_tokens FROM p WHERE truth <> -100 GROUP BY 1
""")
def token_accuracy(spark, sf_dir):
    a = F.col("action")[0].cast("int")
    rows = line_steps(spark, sf_dir).select("episode_id", "t", F.when(F.col("l_partkey") % 5 == 0, -100).otherwise(a).alias("truth"), F.when(F.col("l_partkey") % 3 == 0, a).otherwise(7).alias("guess"))
    return rounded(M.token_metrics(rows, ["episode_id"], "t", "guess", "truth", 2))


@query("windowed_metrics", "SELECT event_type, round(avg(value), 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 100 GROUP BY 1 UNION ALL SELECT 'overall', round(avg(value), 6) FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 100)")
def windowed_metrics(spark, sf_dir):
    return rounded(M.windowed_means(table(spark, sf_dir, "events"), "event_type", "event_id", ["value"], 100))


_pairs = "pr AS (SELECT doc_id, quality, toxic, (doc_id * 37 % 101) / 50.0 AS s0, (doc_id * 53 % 97) / 50.0 AS s1 FROM labels)"


def preference_rows(spark, sf_dir):
    return table(spark, sf_dir, "labels").withColumns({"s0": F.col("doc_id") * 37 % 101 / 50.0, "s1": F.col("doc_id") * 53 % 97 / 50.0, "preference": F.when(F.col("quality") == 1, 1).otherwise(2)})


@query("pref_metrics", f"WITH {_pairs} SELECT round(avg(((s0 - s1 >= 0) = (quality = 1))::INT), 6) AS accuracy, round(avg((s0 - s1 >= 0)::INT), 6) AS label_positive_rate, round(avg((s0 + s1) / 2), 6) AS average_score FROM pr")
def pref_metrics(spark, sf_dir):
    return rounded(M.preference_metrics(preference_rows(spark, sf_dir), "s0", "s1", "preference"))


@query("pref_loss", f"WITH {_pairs} SELECT round(avg(ln(1 + exp(-(s0 - s1)))), 6) AS ranking, round(avg(0.1 * (toxic - (s0 - s1)) * (toxic - (s0 - s1))), 6) AS penalty, round(avg(ln(1 + exp(-(s0 - s1)))) + avg(0.1 * (toxic - (s0 - s1)) * (toxic - (s0 - s1))), 6) AS loss FROM pr")
def pref_loss(spark, sf_dir):
    return rounded(M.preference_loss(preference_rows(spark, sf_dir), "s0", "s1", "toxic", 0.1))


_log = "lg AS (SELECT role, length(text) AS prompt_len, len(string_split(text, ' ')) AS output_len, length(text) / 100.0 + turn AS latency, length(text) / 1000.0 AS ttft, conv_id * 1.5 AS started, turn <> 3 AS success FROM conversations)"


def request_log(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("role", F.length("text").alias("prompt_len"), F.size(F.split("text", " ")).alias("output_len"), (F.length("text") / 100.0 + F.col("turn")).alias("latency"), (F.length("text") / 1000.0).alias("ttft"), (F.col("conv_id") * 1.5).alias("started"), (F.col("turn") != 3).alias("success"))


@query("request_latency", f"""
WITH {_log}, g AS (SELECT *, CASE WHEN output_len > 1 THEN (latency - ttft) / (output_len - 1) END AS tpot, max(started + latency) OVER w - min(started) OVER w AS span FROM lg WHERE success WINDOW w AS (PARTITION BY role))
SELECT role, count(*) AS completed, CAST(sum(prompt_len) AS BIGINT) AS total_input, CAST(sum(output_len) AS BIGINT) AS total_output, round(count(*) / any_value(span), 6) AS request_throughput, round(sum(output_len) / any_value(span), 6) AS output_throughput,
{", ".join(f"round(avg({c}), 6) AS mean_{c}, round(stddev_pop({c}), 6) AS std_{c}, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median_{c}, round(quantile_cont({c}::DOUBLE, 0.99), 6) AS p99_{c}" for c in ("ttft", "tpot", "latency"))} FROM g GROUP BY role
""")
def request_latency(spark, sf_dir):
    return rounded(M.request_metrics(request_log(spark, sf_dir), ["role"]))


@query("aggregate_metrics", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, count(*) AS n FROM events GROUP BY 1")
def aggregate_metrics(spark, sf_dir):
    return rounded(M.metric_table(table(spark, sf_dir, "events"), "event_type", "value"))


@query("pass_at_k", """
WITH s AS (SELECT l_orderkey AS task, count(*) AS n, CAST(sum((l_linestatus = 'O')::INT) AS BIGINT) AS c FROM lineitem GROUP BY 1), k AS (SELECT *, unnest([1, 2, 5]) AS k FROM s)
SELECT task, CAST(k AS INT) AS k, round(CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0 ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i::DOUBLE), lambda a, b: a * b) END, 6) AS pass_at_k FROM k WHERE n >= k
""")
def pass_at_k(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), (F.col("l_linestatus") == "O").alias("passed"))
    return rounded(M.pass_at_k(rows, "task", "passed", [1, 2, 5]))


@query("majority_vote", "WITH a AS (SELECT l_orderkey AS q, CAST(l_quantity AS INT) % 5 AS x, min(l_linenumber * 100000 + l_partkey) AS seen, count(*) AS n FROM lineitem GROUP BY ALL) SELECT q, min_by(x, (-n, seen, x)) AS voted FROM a GROUP BY 1")
def majority_vote(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_quantity").cast("int") % 5).alias("x"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("seen"))
    return M.majority_vote(rows, "q", "x", "seen")


@query("rank_grid", "SELECT p_partkey, p_brand, round((p_retailprice * 7919) % 101, 4) AS error FROM part ORDER BY round((p_retailprice * 7919) % 101, 4), p_partkey LIMIT 10")
def rank_grid(spark, sf_dir):
    """Ten parameter sets of least error."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.round((F.col("p_retailprice") * 7919) % 101, 4).alias("error"))
    return p.orderBy("error", "p_partkey").limit(10)


# ---------------------------------------------------------------- retrieval
_vec = "unnest(range(1, 65)) AS d"


def views(spark, sf_dir):
    e = embedding_steps(spark, sf_dir).where("cameras_avail = 7")
    return e.withColumn("batch", F.col("traj_id") * 1000 + F.floor(F.col("t") / 8))


_views = EMBEDDING_STEPS + """,
v AS (SELECT *, traj_id * 1000 + t // 8 AS batch FROM views WHERE cameras_avail = 7)
"""


def _area(a: str, b: str, c: str) -> str:
    side = lambda x, y: f"list_transform(list_zip({x}::DOUBLE[], {y}::DOUBLE[]), lambda z: z[1] - z[2])"
    u, v = side(b, a), side(c, a)
    return f"sqrt(greatest(0, list_dot_product({u}, {u}) * list_dot_product({v}, {v}) - list_dot_product({u}, {v}) ** 2)) / 2"


@query("triangle_area", f"WITH {_views} SELECT a.batch, a.t AS i, b.t AS j, round({_area('a.ext1', 'b.ext2', 'b.wrist')}, 4) AS area FROM v a JOIN v b ON a.batch = b.batch")
def triangle_area(spark, sf_dir):
    return rounded(R.triangle_areas(views(spark, sf_dir), "batch", "t", "ext1", "ext2", "wrist"), 4)


@query("triangle_retrieval", f"WITH {_views}, p AS (SELECT a.batch, a.t, b.t AS j, round({_area('a.ext1', 'a.ext2', 'b.wrist')}, 9) AS area FROM v a JOIN v b ON a.batch = b.batch), r AS (SELECT batch, t, min_by(j, (area, j)) AS retrieved FROM p GROUP BY ALL) SELECT *, retrieved = t AS correct FROM r")
def triangle_retrieval(spark, sf_dir):
    return R.triangle_retrieval(views(spark, sf_dir), "batch", "t", "ext1", "ext2", "wrist")


@query("triangle_loss", f"""
WITH {_views}, z AS (SELECT a.batch, a.t AS i, b.t AS j, -({_area('a.ext1', 'b.ext2', 'b.wrist')}) / 0.1 AS z FROM v a JOIN v b ON a.batch = b.batch),
r AS (SELECT batch, avg(l) AS loss_i FROM (SELECT batch, i, ln(sum(exp(z))) - 0.9 * max(z) FILTER (i = j) - 0.1 * avg(z) AS l FROM z GROUP BY ALL) GROUP BY 1),
c AS (SELECT batch, avg(l) AS loss_j FROM (SELECT batch, j, ln(sum(exp(z))) - 0.9 * max(z) FILTER (i = j) - 0.1 * avg(z) AS l FROM z GROUP BY ALL) GROUP BY 1)
SELECT batch, round(loss_i, 4) AS loss_i, round(loss_j, 4) AS loss_j, round((loss_i + loss_j) / 2, 4) AS loss FROM r JOIN c USING (batch)
""")
def triangle_loss(spark, sf_dir):
    areas = R.triangle_areas(views(spark, sf_dir), "batch", "t", "ext1", "ext2", "wrist")
    return rounded(R.triangle_loss(areas, "batch", 0.1, 0.1), 4)


_pool = f"WITH {_views}, p AS (SELECT a.batch * 100 + a.t AS q, b.t AS c, a.t AS truth, round(list_dot_product(a.ext1::DOUBLE[], b.ext2::DOUBLE[]), 9) AS score FROM v a JOIN v b ON a.batch = b.batch), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS place, rank() OVER (PARTITION BY q ORDER BY score DESC) AS strict FROM p)"


def pool(spark, sf_dir):
    v = views(spark, sf_dir)
    pairs = R.in_batch(v.select("batch", "t", "ext1"), v.select("batch", "t", "ext2"), "batch")
    return pairs.select((F.col("batch") * 100 + F.col("t")).alias("q"), F.col("r_t").alias("c"), F.col("t").alias("truth"), "batch", F.round(A.dot(F.col("ext1"), F.col("r_ext2")), 9).alias("score"))


@query("retrieval_rank", _pool + " SELECT count(*) AS queries, " + ", ".join(f"round(avg((place <= {k})::INT), 6) AS top_{k}" for k in (1, 2, 3, 4, 5, 10, 20)) + ", round(avg(place), 6) AS mean_rank, round(quantile_cont(place, 0.5), 6) AS median_rank FROM k WHERE c = truth")
def retrieval_rank(spark, sf_dir):
    return rounded(R.retrieval_summary(R.ranks_of_truth(pool(spark, sf_dir), "q", "c", "score", "truth")))


@query("pool_eval", _pool + " SELECT q, place, strict FROM k WHERE c = truth")
def pool_eval(spark, sf_dir):
    return R.ranks_of_truth(pool(spark, sf_dir), "q", "c", "score", "truth")


@query("inbatch_topk", f"""
WITH {_views}, p AS (SELECT a.batch, a.t AS i, b.t AS j, round(list_dot_product(a.ext1::DOUBLE[], b.ext2::DOUBLE[]), 9) AS s FROM v a JOIN v b ON a.batch = b.batch),
k AS (SELECT *, row_number() OVER (PARTITION BY batch, i ORDER BY s DESC, j) AS r, row_number() OVER (PARTITION BY batch, j ORDER BY s DESC, i) AS c FROM p)
SELECT batch, {", ".join(f"CASE WHEN count(*) >= {k} THEN round(avg(({c} <= {k})::INT), 6) END AS {n}_top_{k}" for k in (1, 5) for n, c in (("rows", "r"), ("columns", "c")))} FROM k WHERE i = j GROUP BY batch
""")
def inbatch_topk(spark, sf_dir):
    p = pool(spark, sf_dir).select("batch", F.col("truth").alias("i"), F.col("c").alias("j"), "score")
    return rounded(R.top_k_both_ways(p, "batch", [1, 5]))


@query("verify_embeddings", f"WITH {EMBEDDING_STEPS} SELECT traj_id, count(*) AS length, round(max(abs(sqrt(list_dot_product(ext1::DOUBLE[], ext1::DOUBLE[])) - 1)), 9) AS deviation, TRUE AS unit, count(*) > 49 AS temporal FROM views GROUP BY 1")
def verify_embeddings(spark, sf_dir):
    return rounded(R.verified_embeddings(embedding_steps(spark, sf_dir), "traj_id", ["ext1"], 49), 9)


@query("cosine_by_set", f"WITH {EMBEDDING_STEPS} SELECT traj_id, round(avg(list_cosine_similarity(ext1::DOUBLE[], ext2::DOUBLE[])), 6) AS first_set, round(avg(list_cosine_similarity(ext1::DOUBLE[], wrist::DOUBLE[])), 6) AS second_set FROM views GROUP BY 1")
def cosine_by_set(spark, sf_dir):
    e = embedding_steps(spark, sf_dir)
    return rounded(e.groupBy("traj_id").agg(F.avg(R.cosine(F.col("ext1"), F.col("ext2"))).alias("first_set"), F.avg(R.cosine(F.col("ext1"), F.col("wrist"))).alias("second_set")))


@query("negative_pool", f"""
WITH {EMBEDDING_STEPS}, c AS (SELECT vec_id, traj_id, row_number() OVER (ORDER BY traj_id, {draw_sql('vec_id', 0)}, vec_id) - 1 AS number, count(*) OVER () AS total FROM emb),
q AS (SELECT vec_id, min(number) OVER (PARTITION BY traj_id) AS start, count(*) OVER (PARTITION BY traj_id) AS own, total - count(*) OVER (PARTITION BY traj_id) AS others FROM c),
d AS (SELECT *, try * others // least(5, others) AS low, (try + 1) * others // least(5, others) AS high FROM q, range(5) r(try) WHERE try < others),
t AS (SELECT vec_id, start, own, CAST(low + floor({draw_sql('vec_id * 5 + try', 1)} * (high - low)) + floor({draw_sql('vec_id', 2)} * others) AS BIGINT) % others AS turned FROM d)
SELECT t.vec_id, c.vec_id AS negative FROM t JOIN c ON c.number = turned + CASE WHEN turned < start THEN 0 ELSE own END
""")
def negative_pool(spark, sf_dir):
    e = embedding_steps(spark, sf_dir).select("vec_id", "traj_id")
    return R.negative_pool(e, e, "vec_id", "traj_id", 5)


@query("success_vs_distance", f"WITH {ROLLOUTS}, s AS (SELECT episode_id % 10 AS task, avg(success) AS rate FROM rollouts GROUP BY 1), {EMBEDDING_STEPS.strip()}, d AS (SELECT traj_id AS task, avg(1 - list_cosine_similarity(ext1::DOUBLE[], ext2::DOUBLE[])) AS a, avg(1 - list_cosine_similarity(ext1::DOUBLE[], wrist::DOUBLE[])) AS b FROM views GROUP BY 1), j AS (SELECT task, rate, (a + b) / 2 AS mean_d, least(a, b) AS min_d FROM s JOIN d USING (task)) SELECT task, round(rate, 6) AS rate, round(mean_d, 6) AS mean_distance, round(min_d, 6) AS min_distance, round(corr(rate, mean_d) OVER (), 6) AS r_mean, round(corr(rate, min_d) OVER (), 6) AS r_min FROM j")
def success_vs_distance(spark, sf_dir):
    rate = rollouts(spark, sf_dir).groupBy((F.col("episode_id") % 10).alias("task")).agg(F.avg("success").alias("rate"))
    e = embedding_steps(spark, sf_dir)
    d = e.groupBy(F.col("traj_id").alias("task")).agg(*[F.avg(F.lit(1.0) - R.cosine(F.col("ext1"), F.col(c))).alias(a) for a, c in (("a", "ext2"), ("b", "wrist"))])
    j = rate.join(d, "task").select("task", "rate", ((F.col("a") + F.col("b")) / 2).alias("mean_distance"), F.least("a", "b").alias("min_distance"))
    r = j.agg(F.corr("rate", "mean_distance").alias("r_mean"), F.corr("rate", "min_distance").alias("r_min"))
    return rounded(j.join(F.broadcast(r)))  # one row


@query("explore_dataset", f"WITH {LINE_STEPS}, per AS (SELECT text, count(*) AS n FROM steps GROUP BY 1), dim AS (SELECT CAST(d AS INT) AS dim, CASE d WHEN 0 THEN a0 ELSE a2 END AS x FROM steps, (SELECT unnest([0, 1]) AS d)) SELECT dim, (SELECT min(n) FROM per) AS min_per_instruction, (SELECT max(n) FROM per) AS max_per_instruction, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, min(x) AS min, max(x) AS max, round(avg((x = 5)::INT), 5) AS pad_share FROM dim GROUP BY 1")
def explore_dataset(spark, sf_dir):
    from ..operators.stats import dims

    steps = line_steps(spark, sf_dir).withColumn("v", F.array(F.col("action")[0], F.col("action")[2]))
    per = steps.groupBy("language_instruction").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("min_per_instruction"), F.max("n").alias("max_per_instruction"))
    out = dims(steps, ["v"]).groupBy("dim").agg(*M.spread("x"), F.avg((F.col("x") == 5).cast("double")).alias("pad_share"))
    return rounded(out.join(F.broadcast(per)), 5)  # one row


@query("word_counts", "WITH w AS (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents WHERE lang = 'en'), l AS (SELECT len(string_split(text, ' ')) AS n FROM documents WHERE lang = 'en') SELECT word, count(*) AS n, (SELECT min(n) FROM l) AS shortest, (SELECT max(n) FROM l) AS longest, (SELECT round(quantile_cont(n, 0.5), 6) FROM l) AS median FROM w WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 10")
def word_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    words = docs.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    lengths = docs.select(F.size(F.split("text", " ")).alias("k")).agg(F.min("k").cast("long").alias("shortest"), F.max("k").cast("long").alias("longest"), F.percentile("k", F.lit(0.5)).alias("median"))
    return words.orderBy(F.col("n").desc(), "word").limit(10).join(F.broadcast(lengths))  # one row
