"""Queries of the verifier dataset and its rephrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keyed import draw_sql
from ..operators import augment
from ..operators import filters as P
from ..operators import verifier as V
from ..operators import windows as W
from ..sources.steps import EVENT_STEPS, LINE_STEPS, REPHRASES, TYPED_STEPS, event_steps, line_steps, rephrases
from .base import query


def coarse(spark, sf_dir):
    """Order steps with whole-number actions, so that windows repeat."""
    steps = line_steps(spark, sf_dir).withColumn("action", F.array(F.floor(F.col("action")[0] / 10).cast("double"), F.floor(F.col("action")[2] * 30).cast("double")))
    return W.padded_window(steps, 1, 1)


_coarse = LINE_STEPS + """,
w AS (
  SELECT s.*, floor(s.a0 / 10) AS c0, floor(s.a2 * 30) AS c1 FROM steps s),
windows AS (
  SELECT episode_id, t, lower(text) AS instruction,
    coalesce(lag(c0) OVER e, -5) AS p0, coalesce(lag(c1) OVER e, -5) AS p1, c0, c1, coalesce(lead(c0) OVER e, -5) AS f0, coalesce(lead(c1) OVER e, -5) AS f1
  FROM w WINDOW e AS (PARTITION BY episode_id ORDER BY t))
"""


@query("dedup_windows", f"WITH {_coarse} SELECT p0, p1, c0, c1, f0, f1, count(*) AS n FROM windows GROUP BY ALL")
def dedup_windows(spark, sf_dir):
    samples, histories, _ = V.normal_form(coarse(spark, sf_dir))
    counts = samples.groupBy("action_history_id").agg(F.count(F.lit(1)).alias("n"))
    w = F.flatten("action_window")
    return counts.join(histories, "action_history_id").select(*[w[i].alias(c) for i, c in enumerate(("p0", "p1", "c0", "c1", "f0", "f1"))], "n")


@query("normal_form_meta", f"""
WITH {_coarse}, per AS (SELECT instruction, count(*) AS n FROM windows GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_samples, min(n) AS min_per_instruction, round(avg(n), 6) AS mean_per_instruction, max(n) AS max_per_instruction,
  (SELECT count(*) FROM (SELECT DISTINCT p0, p1, c0, c1, f0, f1 FROM windows)) AS unique_action_histories, count(*) AS unique_instructions,
  round(sum(n) / (SELECT count(*) FROM (SELECT DISTINCT p0, p1, c0, c1, f0, f1 FROM windows)), 6) AS reuse_ratio FROM per
""")
def normal_form_meta(spark, sf_dir):
    out = V.normal_form_metadata(V.normal_form(coarse(spark, sf_dir))[0])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_per_instruction", "reuse_ratio")})


@query("dedup_instructions", f"""
WITH {REPHRASES}, k AS (SELECT trim(regexp_replace(trim(lower(rephrase)), '[.?!]+$', '')) AS text FROM rephrases)
SELECT text, count(*) AS n FROM k WHERE text <> '' GROUP BY text
""")
def dedup_instructions(spark, sf_dir):
    return rephrases(spark, sf_dir).select(X.key_a(F.col("rephrase")).alias("text")).where("text IS NOT NULL").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def rephrase_table(spark, sf_dir):
    """Three rephrases of each event type, one of them an original too."""
    types = event_steps(spark, sf_dir).select(F.col("event_type").alias("original")).distinct()
    other = F.when(F.col("original") == "view", F.lit("click")).otherwise(F.concat(F.lit("please "), F.col("original")))
    return types.select("original", F.posexplode(F.array(F.concat(F.lit("do "), F.col("original")), other, F.concat(F.col("original"), F.lit(" now")))).alias("pos", "rephrase"))


_table = """
rt AS (
  SELECT original, CAST(pos AS INT) AS pos, CASE pos WHEN 0 THEN 'do ' || original WHEN 1 THEN CASE original WHEN 'view' THEN 'click' ELSE 'please ' || original END ELSE original || ' now' END AS rephrase
  FROM (SELECT DISTINCT event_type AS original FROM events), (SELECT unnest([0, 1, 2]) AS pos))
"""


@query("rephrase_fanout", f"WITH {EVENT_STEPS}, {_table} SELECT episode_id, t, text AS instruction, text, 0 AS pos FROM steps UNION ALL SELECT s.episode_id, s.t, s.text, r.rephrase, r.pos FROM steps s JOIN rt r ON r.original = s.text")
def rephrase_fanout(spark, sf_dir):
    samples = event_steps(spark, sf_dir).select("episode_id", "t", F.col("language_instruction").alias("instruction"))
    return V.rephrase_fanout(samples, rephrase_table(spark, sf_dir))


@query("rephrase_new_keys", f"WITH {_table} SELECT rephrase, min(original) AS original FROM rt WHERE rephrase NOT IN (SELECT original FROM rt) GROUP BY rephrase")
def rephrase_new_keys(spark, sf_dir):
    return V.new_instruction_keys(rephrase_table(spark, sf_dir))


@query("rephrase_merge", f"""
WITH {REPHRASES}, f AS (SELECT suite, original, rephrase, doc_id % 3 AS file, pos FROM rephrases WHERE trim(rephrase) <> ''),
first AS (SELECT suite, original, rephrase, min((file, pos)) AS k FROM f GROUP BY ALL)
SELECT suite, original, rephrase, CAST(row_number() OVER (PARTITION BY suite, original ORDER BY k, rephrase) - 1 AS INT) AS pos FROM first
""")
def rephrase_merge(spark, sf_dir):
    files = rephrases(spark, sf_dir).withColumn("file", F.col("doc_id") % 3)
    return V.merged_rephrases(files)


@query("rephrase_dedup", f"""
WITH {REPHRASES}, g AS (SELECT *, lower(trim(rephrase)) AS k FROM rephrases WHERE length(trim(rephrase)) >= 10 AND lower(trim(rephrase)) <> lower(trim(original)))
SELECT original, rephrase, pos FROM (SELECT *, row_number() OVER (PARTITION BY original, k ORDER BY pos, rephrase, doc_id) AS r FROM g) WHERE r = 1
""")
def rephrase_dedup(spark, sf_dir):
    return V.dedup_rephrases(rephrases(spark, sf_dir)).select("original", "rephrase", "pos")


@query("rephrase_load", f"""
WITH {REPHRASES} SELECT CAST(doc_id AS VARCHAR) AS id, original, CAST(row_number() OVER (PARTITION BY doc_id, original ORDER BY pos) - 1 AS INT) AS pos, rephrase
FROM rephrases WHERE trim(original) <> '' AND trim(rephrase) <> ''
""")
def rephrase_load(spark, sf_dir):
    """Rephrase lists written as a JSON map and read back with blank ones dropped."""
    from ..sources.records import load_rephrases
    from ..sources.storage import scratch

    path = scratch(spark)
    lists = rephrases(spark, sf_dir).groupBy("doc_id", "original").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "rephrase"))), lambda r: r["rephrase"]).alias("rephrases"))
    lists.select(F.col("doc_id").cast("string").alias("id"), "original", "rephrases").write.json(path)
    return load_rephrases(spark, path)


@query("prepend_alternates", f"""
WITH {_table}, alt AS (SELECT DISTINCT event_type AS original, CAST(user_id % 3 AS INT) AS pos, CASE user_id % 3 WHEN 0 THEN 'DO ' || event_type || '!' WHEN 1 THEN 'quickly ' || event_type ELSE 'slowly, ' || event_type END AS rephrase FROM events),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(rephrase), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS k FROM alt),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(rephrase), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS k FROM rt),
fresh AS (SELECT original, pos, rephrase, 0 AS o FROM k WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.original = k.original AND n.k = k.k)),
b AS (SELECT * FROM fresh UNION ALL SELECT original, pos, rephrase, 1 FROM n)
SELECT original, rephrase, CAST(row_number() OVER (PARTITION BY original ORDER BY o, pos, rephrase) - 1 AS INT) AS pos FROM b
""")
def prepend_alternates(spark, sf_dir):
    e = event_steps(spark, sf_dir).select(F.col("event_type").alias("original"), (F.col("episode_id") % 3).cast("int").alias("pos")).distinct()
    text = F.when(F.col("pos") == 0, F.concat(F.lit("DO "), F.col("original"), F.lit("!"))).when(F.col("pos") == 1, F.concat(F.lit("quickly "), F.col("original"))).otherwise(F.concat(F.lit("slowly, "), F.col("original")))
    return V.prepended_alternates(rephrase_table(spark, sf_dir), e.withColumn("rephrase", text), X.key_b)


@query("trim_rephrases", f"""
WITH {REPHRASES}, v AS (SELECT doc_id, rephrase, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM rephrases)
SELECT rephrase AS text, count(*) AS n FROM v WHERE r <= 3 GROUP BY 1
""")
def trim_rephrases(spark, sf_dir):
    """The first 1 + 2 variants of each document; instructions that are no longer used are gone."""
    samples = rephrases(spark, sf_dir).withColumn("instruction_id", F.md5(F.col("rephrase").cast("binary")))
    instructions = samples.select("instruction_id", F.col("rephrase").alias("text")).distinct()
    kept, used = V.trim_rephrases(samples, instructions, 2, ["doc_id"], ["pos"])
    return kept.join(used, "instruction_id").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("orphan_dims", f"""
WITH {REPHRASES}, v AS (SELECT doc_id, rephrase, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM rephrases)
SELECT DISTINCT rephrase AS text FROM v EXCEPT SELECT rephrase FROM v WHERE r <= 3
""")
def orphan_dims(spark, sf_dir):
    samples = rephrases(spark, sf_dir).withColumn("text", F.col("rephrase"))
    kept, _ = V.trim_rephrases(samples.withColumn("instruction_id", F.col("text")), samples.select(F.col("text").alias("instruction_id")).distinct(), 2, ["doc_id"], ["pos"])
    return V.orphans(samples.select("text").distinct(), kept, "text")


@query("pick_variant", f"""
WITH v AS (SELECT doc_id, string_split(text, chr(10))[1:4] AS ls FROM documents)
SELECT doc_id, ls[CAST(floor({draw_sql('doc_id', 5)} * len(ls)) AS INT) + 1] AS variant FROM v
""")
def pick_variant(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", "\n").alias("ls"))
    return V.picked_variant(docs, "ls", 4, F.col("doc_id"), 5).select("doc_id", "variant")


@query("alternate_sets", f"""
WITH {REPHRASES}, k AS (SELECT rephrase, trim(regexp_replace(regexp_replace(lower(rephrase), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM rephrases)
SELECT key, count(DISTINCT rephrase) AS n, min(rephrase) AS first FROM k WHERE key <> '' GROUP BY key
""")
def alternate_sets(spark, sf_dir):
    """Over all rephrases, whatever their letters and marks."""
    sets = V.alternate_sets(rephrases(spark, sf_dir), X.key_b(F.col("rephrase")), "rephrase")
    return sets.select("key", F.size("alternates").cast("long").alias("n"), F.col("alternates")[0].alias("first"))


@query("valid_samples", f"WITH {LINE_STEPS} SELECT episode_id, t FROM steps WHERE text <> 'N' AND NOT (n % 3 = 0) AND l_partkey % 2 = 0")
def valid_samples(spark, sf_dir):
    """Instructions of N are missing, histories of odd parts too, and windows of episodes of length 3, 6, .. are short."""
    w = coarse(spark, sf_dir).withColumns({"action_history_id": F.concat_ws("-", "episode_id", "t"), "instruction_id": F.col("language_instruction")})
    w = w.withColumn("action_window", F.when(F.col("n") % 3 == 0, F.slice("action_window", 1, 2)).otherwise(F.col("action_window")))
    histories = w.where("l_partkey % 2 = 0").select("action_history_id", "action_window")
    instructions = w.select("instruction_id").distinct().where("instruction_id <> 'N'")
    return P.valid_samples(w.select("episode_id", "t", "action_history_id", "instruction_id"), histories, instructions, 3).select("episode_id", "t")


@query("word_shuffle")
def word_shuffle(spark, sf_dir):
    lines = rephrases(spark, sf_dir)
    return lines.select("doc_id", "pos", augment.shuffled_words(F.col("rephrase"), F.xxhash64("doc_id", "pos")).alias("shuffled"))


@query("export_instr", f"""
WITH {TYPED_STEPS}, f AS (
  SELECT user_id, min_by(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS first_text, max((event_type = 'purchase')::INT) AS ok FROM events GROUP BY user_id)
SELECT user_id AS episode_id, coalesce(first_text, 'task ' || CAST(user_id % 7 AS VARCHAR)) AS instruction FROM f WHERE ok = 1
""")
def export_instr(spark, sf_dir):
    """First instruction that is not blank of each successful episode, else the task table's text."""
    steps = event_steps(spark, sf_dir).withColumn("language_instruction", F.when(F.col("language_instruction") == "error", " ").otherwise(F.col("language_instruction")))
    first = steps.groupBy("episode_id").agg(F.min(F.when(X.key_d(F.col("language_instruction")).isNotNull(), F.struct("t", X.key_d(F.col("language_instruction")).alias("x")))).alias("f"), F.max((F.col("event_type") == "purchase").cast("int")).alias("ok"))
    tasks = spark.range(7).select(F.col("id").alias("task_index"), F.concat(F.lit("task "), F.col("id").cast("string")).alias("task"))
    joined = first.where("ok = 1").withColumn("task_index", F.col("episode_id") % 7).join(tasks, "task_index", "left")
    return joined.select("episode_id", F.coalesce("f.x", "task").alias("instruction"))
