"""Queries of instruction text, chat, question answering and joins by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keyed import draw_sql
from ..operators import chat as C
from ..operators import joins as J
from ..operators import standardize as S
from ..sources import records
from ..sources.steps import EMBEDDING_STEPS, EVENT_STEPS, REPHRASES, ROLLOUTS, embedding_steps, event_steps, rephrases, rollouts, table
from .base import query
from .evaluation import rounded

ID = ["episode_id", "t"]


def variants(spark, sf_dir):
    """Every rephrase line with upper-cased, padded, marked and blank variants by position."""
    p = F.col("pos") % 5
    s = F.col("rephrase")
    v = F.when(p == 0, F.upper(F.replace(s, F.lit("ß"), F.lit("ss")))).when(p == 1, F.concat(F.lit("  "), s, F.lit("?!"))).when(p == 2, F.lit("")).when(p == 3, F.concat(s, F.lit(" demo"))).otherwise(s)
    return rephrases(spark, sf_dir).withColumn("s", v)


VARIANTS = REPHRASES + """,
var AS (SELECT doc_id, pos, CASE pos % 5 WHEN 0 THEN upper(replace(rephrase, 'ß', 'ss')) WHEN 1 THEN '  ' || rephrase || '?!' WHEN 2 THEN '' WHEN 3 THEN rephrase || ' demo' ELSE rephrase END AS s FROM rephrases)
"""
_a = "trim(regexp_replace(trim(lower(s)), '[.?!]+$', ''))"


@query("norm_instr_a", f"WITH {VARIANTS} SELECT doc_id, pos, nullif({_a}, '') AS key FROM var")
def norm_instr_a(spark, sf_dir):
    return variants(spark, sf_dir).select("doc_id", "pos", X.key_a(F.col("s")).alias("key"))


@query("norm_instr_b", f"WITH {VARIANTS} SELECT doc_id, pos, trim(regexp_replace(regexp_replace(lower(s), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM var")
def norm_instr_b(spark, sf_dir):
    return variants(spark, sf_dir).select("doc_id", "pos", X.key_b(F.col("s")).alias("key"))


@query("norm_instr_c", f"WITH {VARIANTS} SELECT doc_id, pos, nullif(trim(regexp_replace({_a}, ' demo$', '')), '') AS key FROM var")
def norm_instr_c(spark, sf_dir):
    return variants(spark, sf_dir).select("doc_id", "pos", X.key_c(F.col("s")).alias("key"))


@query("first_instr", f"WITH {VARIANTS} SELECT doc_id, pos, coalesce(nullif(trim(CASE WHEN pos % 5 = 2 THEN '' ELSE s END), ''), nullif(trim(CASE WHEN pos % 2 = 0 THEN ' ' ELSE 'two' END), ''), 'three') AS text FROM var")
def first_instr(spark, sf_dir):
    v = variants(spark, sf_dir)
    return v.select("doc_id", "pos", X.first_filled(F.col("s"), F.when(F.col("pos") % 2 == 0, " ").otherwise("two"), F.lit("three")).alias("text"))


@query("apply_tree", f"WITH {EVENT_STEPS} SELECT episode_id, t, round(a0 * 2, 6) AS primary_x, a1 AS wrist_x, round(a1 * 2, 6) AS top_x, text FROM steps")
def apply_tree(spark, sf_dir):
    """Leaves whose path ends in an x below a chosen branch are doubled."""
    steps = event_steps(spark, sf_dir)
    nested = steps.select(*ID, F.struct(F.struct(F.col("action")[0].alias("x"), F.col("language_instruction").alias("text")).alias("primary"), F.struct(F.col("action")[1].alias("x")).alias("wrist")).alias("views"), F.struct(F.col("action")[1].alias("x")).alias("top"))
    rows = S.map_columns(nested, lambda path: path in ("views/primary/x", "top/x"), lambda c: c * 2)
    return rows.select(*ID, F.round("views.primary.x", 6).alias("primary_x"), F.col("views.wrist.x").alias("wrist_x"), F.round("top.x", 6).alias("top_x"), F.col("views.primary.text").alias("text"))


@query("transform_groups", f"WITH {EVENT_STEPS} SELECT episode_id, t, round(least(1.0, greatest(-1.0, a0 / 100)) + 1, 6) AS x FROM steps")
def transform_groups(spark, sf_dir):
    """Inputs: repack, data, normalize, model, in this order; another order would give other rows."""
    repack = [lambda d: d.select(*ID, F.col("action")[0].alias("x"))]
    data = [lambda d: d.withColumn("x", F.col("x") / 100)]
    normalize = [lambda d: d.withColumn("x", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x"))))]
    model = [lambda d: d.withColumn("x", F.round(F.col("x") + 1, 6))]
    return S.composed(repack, data, normalize, model)(event_steps(spark, sf_dir))


@query("build_prompt", f"WITH {EVENT_STEPS} SELECT episode_id, t, 'In: What action should the robot take to ' || lower(text) || '?' || chr(10) || 'Out: ' || CAST(CAST(floor(a1 * 99 + 0.5) AS INT) AS VARCHAR) || '</s>' AS prompt FROM steps")
def build_prompt(spark, sf_dir):
    answer = F.floor(F.col("action")[1] * 99 + 0.5).cast("int").cast("string")
    return event_steps(spark, sf_dir).select(*ID, X.action_prompt(F.col("language_instruction"), answer).alias("prompt"))


@query("chunk_prompt", f"""
WITH {EVENT_STEPS}, p AS (SELECT s.*, unnest(range(0, 3)) AS o FROM steps s)
SELECT p.episode_id, p.t, string_agg(CAST(CAST(floor(m.a1 * 99 + 0.5) AS INT) AS VARCHAR), ' ' ORDER BY o) AS answer FROM p JOIN steps m ON m.episode_id = p.episode_id AND m.t = least(p.t + p.o, p.n - 1) GROUP BY ALL
""")
def chunk_prompt(spark, sf_dir):
    """Tokens of the current action and of the two after it in one answer."""
    from ..operators.windows import padded_window

    w = padded_window(event_steps(spark, sf_dir), 0, 2, pad="last")
    return w.select(*ID, F.array_join(F.transform("action_window", lambda a: F.floor(a[1] * 99 + 0.5).cast("int").cast("string")), " ").alias("answer"))


@query("clean_prompt", f"WITH {VARIANTS} SELECT doc_id, pos, translate(trim(s || '_x' || chr(10) || 'y '), '_' || chr(10), '  ') AS prompt FROM var")
def clean_prompt(spark, sf_dir):
    return variants(spark, sf_dir).select("doc_id", "pos", X.clean_prompt(F.concat("s", F.lit("_x\ny "))).alias("prompt"))


@query("image_tag", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '<image>' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS text FROM documents")
def image_tag(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    tagged = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" <image>"))).otherwise(F.concat(F.lit("<image>\n"), "text"))
    return d.select("doc_id", X.image_tag_first(tagged).alias("text"))


@query("qa_to_chat", "SELECT item_id, trim(split_part(text, '. ', 1)) AS question, trim(split_part(text, '. ', 2)) AS answer, CAST(2 AS INT) AS n FROM benchmark")
def qa_to_chat(spark, sf_dir):
    parts = F.split("text", r"\. ")
    rows = table(spark, sf_dir, "benchmark").select("item_id", C.two_turns(F.concat(F.lit("Question: "), parts[0]), F.concat(F.lit(" Answer:"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))).alias("c"))
    return rows.select("item_id", F.col("c")[0]["value"].alias("question"), F.col("c")[1]["value"].alias("answer"), F.size("c").alias("n"))


@query("qa_layouts", "SELECT item_id, 'Question: ' || text || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'Context: c' ELSE '' END || chr(10) || 'Options: (A) x' AS prompt, 'Lecture: l' || chr(10) || 'Answer: A' AS response FROM benchmark")
def qa_layouts(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").withColumns({"question": F.col("text"), "context": F.when(F.col("item_id") % 2 == 0, "c"), "options": F.lit("(A) x"), "lecture": F.lit("l"), "solution": F.lit(""), "answer": F.lit("A")})
    ask, reply = C.layout("QCM-LA")
    return rows.select("item_id", ask.alias("prompt"), reply.alias("response"))


@query("rows_to_chat", "SELECT CAST(page_id AS BIGINT) AS id, 'p' || CAST(page_id AS VARCHAR) || '.png' AS image, '<image>' || chr(10) || 'What is the address?' AS first, url AS answer, CAST(4 AS INT) AS n FROM pages")
def rows_to_chat(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".png")).alias("image"), F.lit("What is the address?").alias("q1"), "url", F.lit("Which page?").alias("q2"), F.col("page_id").cast("string").alias("a2"))
    c = C.rows_to_chat(p, "page_id", [("q1", "url"), ("q2", "a2")], "image")
    return c.select("id", "image", F.col("conversations")[0]["value"].alias("first"), F.col("conversations")[1]["value"].alias("answer"), F.size("conversations").alias("n"))


@query("dialogue_prompt", "SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN 'Out: ' || text || '</s>' || chr(10) ELSE 'In: ' || text || chr(10) END, '' ORDER BY turn) AS prompt, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS trained_chars FROM conversations GROUP BY conv_id")
def dialogue_prompt(spark, sf_dir):
    return C.dialogue_prompt(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("few_shot", "SELECT string_agg('Question: ' || text || chr(10) || 'Answer: ' || CAST(item_id AS VARCHAR) || chr(10) || chr(10), '' ORDER BY item_id) AS head FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 5)")
def few_shot(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("answer", F.col("item_id").cast("string"))
    return C.few_shot(b, "item_id", "text", "answer", 5)


@query("two_turn_requests", """
WITH c AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS p, max(CASE WHEN turn = 1 THEN text END) AS q FROM conversations GROUP BY 1)
SELECT conv_id, CAST(len(string_split(p, ' ')) AS INT) AS prompt_len, CAST(len(string_split(q, ' ')) AS INT) AS output_len FROM c
WHERE p IS NOT NULL AND q IS NOT NULL AND len(string_split(p, ' ')) BETWEEN 4 AND 60 AND len(string_split(q, ' ')) >= 4 AND len(string_split(p, ' ')) + len(string_split(q, ' ')) <= 200
""")
def two_turn_requests(spark, sf_dir):
    return C.two_turn_requests(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 4, 60, 200).select("conv_id", "prompt_len", "output_len")


@query("parse_list", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS n, trim(string_split(text, chr(10))[1]) AS first FROM documents WHERE NOT regexp_matches(text, '(^|\\n)\\s*(\\n|$)') AND NOT regexp_matches(text, '[\\x09-\\x0D]( |$)')")
def parse_list(spark, sf_dir):
    """Numbered lines are made from documents' lines and parsed again."""
    d = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"(^|\n)\s*(\n|$)") & ~F.col("text").rlike(r"[\x09-\x0D]( |$)"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    listed = F.concat(F.lit("Here they are:\n"), F.array_join(lines, "\n"))
    return d.select("doc_id", X.numbered_items(listed).alias("p")).select("doc_id", F.size("p").alias("n"), F.col("p")[0].alias("first"))


@query("parse_score", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id % 10 WHEN 1 THEN doc_id % 10 + 0.5 ELSE -1 END::DOUBLE AS a, CASE doc_id % 4 WHEN 0 THEN 7.5 WHEN 1 THEN 3 ELSE -1 END::DOUBLE AS b FROM labels")
def parse_score(spark, sf_dir):
    k = (F.col("doc_id") % 10).cast("string")
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(k, F.lit(", 7.5\nreview"))).when(F.col("doc_id") % 4 == 1, F.concat(k, F.lit(".5 3"))).when(F.col("doc_id") % 4 == 2, F.concat(k, F.lit("\n5"))).otherwise("none given")
    return table(spark, sf_dir, "labels").select("doc_id", X.score_pair(text).alias("s")).select("doc_id", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))


@query("name_clean", "SELECT page_id, replace(regexp_replace(regexp_extract(url || '/pick_up_the_cup_demo.hdf5', '([^/]*)$', 1), '\\.[A-Za-z0-9]+$', ''), '_', ' ') AS task, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM pages")
def name_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.task_name(F.concat("url", F.lit("/pick_up_the_cup_demo.hdf5"))).alias("task"), X.safe_name(F.col("url")).alias("safe"))


@query("default_prompt", f"WITH {EVENT_STEPS} SELECT episode_id, t, CASE WHEN text = 'error' THEN 'be useful' ELSE text END AS prompt FROM steps")
def default_prompt(spark, sf_dir):
    text = F.when(F.col("language_instruction") != "error", F.col("language_instruction"))
    return event_steps(spark, sf_dir).select(*ID, F.coalesce(text, F.lit("be useful")).alias("prompt"))


@query("repack", f"WITH {EVENT_STEPS} SELECT episode_id, t, a0 AS value, text AS prompt FROM steps")
def repack(spark, sf_dir):
    nested = event_steps(spark, sf_dir).select("episode_id", "t", F.struct(F.col("action")[0].alias("x")).alias("observation"), F.struct(F.col("language_instruction").alias("text")).alias("task"))
    return S.repack(nested, {"episode_id": "episode_id", "t": "t", "value": "observation/x", "prompt": "task/text"})


@query("rename_regex", "SELECT o_orderkey AS key, o_totalprice AS \"order/totalprice\", o_orderstatus AS \"order/status\" FROM orders")
def rename_regex(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    return S.renamed(orders, [(r"o_orderkey", "key"), (r".*date", None), (r"o_(?:order)?(.*)", r"order/\1")])


@query("restructure", f"WITH {EVENT_STEPS} SELECT episode_id, t, t AS timestep, 'events' AS dataset_name, 'i' || CAST(event_id AS VARCHAR) AS image_primary, '' AS image_wrist, round(a1, 6) AS p0, 0.0 AS p2, text AS language_instruction FROM steps")
def restructure(spark, sf_dir):
    raw = event_steps(spark, sf_dir).withColumns({"cam": F.concat(F.lit("i"), F.col("event_id").cast("string")), "instr": F.col("language_instruction")})
    out = S.restructure(raw, "events", {"primary": "cam", "wrist": None}, ["proprio", None], "instr")
    return out.select(*ID, "timestep", "dataset_name", "image_primary", "image_wrist", F.round(F.col("proprio")[0], 6).alias("p0"), F.col("proprio")[2].alias("p2"), "language_instruction")


# ---------------------------------------------------------------- joins by key
@query("enrich_actions", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS r FROM lineitem)
SELECT o_orderkey, o_orderstatus, l_partkey, l_quantity FROM orders LEFT JOIN l ON o_orderkey = l_orderkey AND r = 1
""")
def enrich_actions(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = J.enriched(table(spark, sf_dir, "orders"), lines, "o_orderkey", order, ["l_partkey", "l_quantity"])
    return out.select("o_orderkey", "o_orderstatus", "l_partkey", "l_quantity")


@query("prompt_from_task", "SELECT o_orderkey, n_name AS prompt FROM orders JOIN nation ON n_nationkey = o_orderkey % 25")
def prompt_from_task(spark, sf_dir):
    tasks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("task_index"), F.col("n_name").alias("task"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 25).alias("task_index"))
    return records.prompt_from_task(rows, tasks).select("o_orderkey", "prompt")


@query("align_sets", f"WITH {REPHRASES}, k AS (SELECT DISTINCT suite, pos, min(rephrase) AS r, doc_id // 20 % 4 AS s FROM rephrases GROUP BY ALL) SELECT a.suite, a.pos, a.r AS s0, b.r AS s1, c.r AS s2, d.r AS s3 FROM k a JOIN k b USING (suite, pos) JOIN k c USING (suite, pos) JOIN k d USING (suite, pos) WHERE a.s = 0 AND b.s = 1 AND c.s = 2 AND d.s = 3")
def align_sets(spark, sf_dir):
    r = rephrases(spark, sf_dir).groupBy("suite", "pos", (F.floor(F.col("doc_id") / 20) % 4).alias("s")).agg(F.min("rephrase").alias("r"))
    return J.aligned_sets({f"s{i}": r.where(f"s = {i}") for i in range(4)}, ["suite", "pos"], "r")


@query("task_semi", f"WITH {EVENT_STEPS} SELECT episode_id, t FROM steps WHERE event_type IN ('view', 'click', 'signup')")
def task_semi(spark, sf_dir):
    tasks = spark.createDataFrame([("View.",), ("CLICK!",), (" signup ",), ("other",)], "name string")
    return J.present_tasks(event_steps(spark, sf_dir), tasks, X.key_a(F.col("event_type")), X.key_a(F.col("name"))).select(*ID)


@query("combined_rates", f"WITH {ROLLOUTS} SELECT coalesce(a.task, b.task) AS task, a.rate AS base, b.rate AS ours FROM (SELECT episode_id % 7 AS task, round(avg(success), 6) AS rate FROM rollouts WHERE episode_id % 7 < 5 GROUP BY 1) a FULL JOIN (SELECT episode_id % 7 AS task, round(avg(1 - success), 6) AS rate FROM rollouts WHERE episode_id % 7 > 2 GROUP BY 1) b ON a.task = b.task")
def combined_rates(spark, sf_dir):
    r = rollouts(spark, sf_dir).select((F.col("episode_id") % 7).alias("task"), "success")
    base = r.where("task < 5").groupBy("task").agg(F.round(F.avg("success"), 6).alias("rate"))
    ours = r.where("task > 2").groupBy("task").agg(F.round(F.avg(F.lit(1) - F.col("success")), 6).alias("rate"))
    return J.combined_rates({"base": base, "ours": ours, "absent": None}, "task", "rate")


@query("missing_images", "SELECT DISTINCT 'p' || CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id NOT IN (SELECT page_id * 3 FROM pages)")
def missing_images(spark, sf_dir):
    refs = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"))
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), (F.col("page_id") * 3).cast("string")).alias("path"))
    return J.missing_files(refs, files, "path")


@query("frame_offset", f"WITH {EVENT_STEPS} SELECT episode_id, t, CAST(round(episode_id * 3) AS BIGINT) + t AS video_frame FROM steps")
def frame_offset(spark, sf_dir):
    steps = event_steps(spark, sf_dir).select(*ID, F.col("t").alias("frame_index"))
    episodes = steps.select("episode_id").distinct().withColumn("from_timestamp", F.col("episode_id") * 0.2)
    return J.video_frames(steps, episodes, 15).select(*ID, "video_frame")


# ---------------------------------------------------------------- answers
@query("qa_join", "SELECT d.doc_id, l.quality AS ours, CASE WHEN d.doc_id % 2 = 0 THEN l.toxic END AS other FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id % 2 = 0")
def qa_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return J.joined_answers(table(spark, sf_dir, "documents").select("doc_id"), {"ours": labels.select("doc_id", "quality").withColumnRenamed("quality", "v"), "other": labels.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("v"))}, "doc_id", "v")


@query("qa_assemble", "SELECT c0.conv_id, c0.text AS question, c1.text AS answer1, c2.text AS answer2, CAST(length(c1.text) AS INT) AS score1, CAST(length(c2.text) AS INT) AS score2 FROM conversations c0 JOIN conversations c1 ON c1.conv_id = c0.conv_id AND c1.turn = 1 JOIN conversations c2 ON c2.conv_id = c0.conv_id AND c2.turn = 2 WHERE c0.turn = 0")
def qa_assemble(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    at = lambda i: c.where(f"turn = {i}").select("conv_id", "text")
    rows = J.joined_answers(at(0).withColumnRenamed("text", "question"), {"answer1": at(1), "answer2": at(2)}, "conv_id", "text")
    return rows.select("conv_id", F.struct("question", "answer1", "answer2", F.length("answer1").alias("score1"), F.length("answer2").alias("score2")).alias("r")).select("conv_id", "r.*")


_answers = "an AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'The answer is B.' WHEN 1 THEN 'a' WHEN 2 THEN 'It is C. The answer is C.' ELSE 'The answer is D. The answer is A.' END AS text, doc_id % 3 AS truth FROM labels)"


def answers(spark, sf_dir):
    k = F.col("doc_id") % 4
    text = F.when(k == 0, "The answer is B.").when(k == 1, "a").when(k == 2, "It is C. The answer is C.").otherwise("The answer is D. The answer is A.")
    return table(spark, sf_dir, "labels").select("doc_id", text.alias("text"), (F.col("doc_id") % 3).alias("truth"))


_GUESS = f"CAST(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE floor({draw_sql('doc_id')} * 5) END AS INT)"


@query("mc_accuracy", f"WITH {_answers} SELECT count(*) AS n, round(avg(({_GUESS} = truth)::INT), 6) AS accuracy FROM an")
def mc_accuracy(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn("guess", J.option_index(F.col("text"), "ABCDE", F.col("doc_id")))
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("guess") == F.col("truth")).cast("double")).alias("accuracy")))


@query("mc_unclear", f"SELECT doc_id, {_GUESS} AS guess FROM labels")
def mc_unclear(spark, sf_dir):
    """The letter's place; unclear answers get a keyed choice."""
    return answers(spark, sf_dir).select("doc_id", J.option_index(F.col("text"), "ABCDE", F.col("doc_id")).alias("guess"))


@query("ensemble_accuracy", "WITH r AS (SELECT doc_id % 3 AS truth, doc_id % 4 AS ours, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 7 END AS other FROM labels) SELECT count(*) AS n, round(avg((ours = truth)::INT), 6) AS ours, round(avg(coalesce(other = truth, FALSE)::INT), 6) AS other, round(avg((coalesce(other, ours) = truth)::INT), 6) AS fallback, round(avg(greatest((ours = truth)::INT, coalesce(other = truth, FALSE)::INT)), 6) AS upper_bound FROM r")
def ensemble_accuracy(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select((F.col("doc_id") % 3).alias("truth"), (F.col("doc_id") % 4).alias("ours"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 7).alias("other"))
    return rounded(J.ensemble_accuracy(r, "ours", "other", "truth"))


@query("last_number_accuracy", "WITH r AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id * 1000 END AS x FROM labels) SELECT count(*) AS n, round(avg((x = doc_id * 1000 AND doc_id % 2 = 1)::INT), 6) AS accuracy, round(avg((x IS NULL)::INT), 6) AS invalid FROM (SELECT doc_id, coalesce(x, NULL) AS x FROM r)".replace("avg((x = doc_id * 1000 AND doc_id % 2 = 1)::INT)", "avg(coalesce(x = doc_id * 1000 AND doc_id % 2 = 1, FALSE)::INT)"))
def last_number_accuracy(spark, sf_dir):
    text = F.when(F.col("doc_id") % 6 == 0, F.lit("no idea")).otherwise(F.concat(F.lit("3 steps, so "), F.format_number(F.col("doc_id") * 1000, 0), F.lit(" it is")))
    r = table(spark, sf_dir, "labels").select("doc_id", X.last_integer(text).alias("x"))
    right = F.coalesce((F.col("x") == F.col("doc_id") * 1000) & (F.col("doc_id") % 2 == 1), F.lit(False))
    return rounded(r.agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.avg(F.col("x").isNull().cast("double")).alias("invalid")))


@query("subject_accuracy", "WITH r AS (SELECT source, (doc_id % 3 = 0)::INT AS ok FROM documents) SELECT source AS \"group\", round(avg(ok), 6) AS accuracy, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'all', round(avg(ok), 6), count(*) FROM r")
def subject_accuracy(spark, sf_dir):
    return rounded(J.grouped_accuracy(table(spark, sf_dir, "documents"), F.array("source"), F.col("doc_id") % 3 == 0))


@query("contains_accuracy", "SELECT round(avg((contains(text, 'the') AND contains(text, 'of'))::INT), 6) AS words, round(avg((list_contains(regexp_extract_all('a ' || CAST(doc_id AS VARCHAR) || ' b 12', '[0-9]+'), CAST(doc_id % 100 AS VARCHAR)))::INT), 6) AS numbers FROM documents")
def contains_accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("a "), F.col("doc_id").cast("string"), F.lit(" b 12"))
    return rounded(d.agg(F.avg(J.contains_all(F.col("text"), F.lit("the of")).cast("double")).alias("words"), F.avg(J.any_number(text, F.col("doc_id") % 100).cast("double")).alias("numbers")))


@query("prefix_answer", """
WITH r AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'latin' WHEN 'de' THEN 'latin' ELSE 'other' END AS g, (doc_id % 2 = 0)::INT AS ok FROM documents)
SELECT k AS "group", round(avg(ok), 6) AS accuracy, count(*) AS n FROM (SELECT lang AS k, ok FROM r UNION ALL SELECT g, ok FROM r UNION ALL SELECT 'all', ok FROM r) GROUP BY k
""")
def prefix_answer(spark, sf_dir):
    prefixes = spark.createDataFrame([("en", "Answer"), ("de", "Antwort"), ("fr", "Réponse"), ("es", "Respuesta")], "lang string, prefix string")
    d = table(spark, sf_dir, "documents").join(F.broadcast(prefixes), "lang")  # four rows
    value = F.when(F.col("doc_id") % 2 == 0, F.format_number(F.col("doc_id") * 1000, 2)).otherwise(F.lit("unknown"))
    said = F.concat(F.lit("First 12. "), F.col("prefix"), F.lit(": "), value, F.lit(" is it"))
    right = J.prefix_answer(said, F.col("prefix")) == (F.col("doc_id") * 1000).cast("string")
    group = F.when(F.col("lang").isin("en", "de"), "latin").otherwise("other")
    return rounded(J.grouped_accuracy(d.withColumn("ok", right), F.array("lang", group), F.col("ok")))


@query("category_accuracy", """
WITH c AS (SELECT source, CASE WHEN source IN ('src0', 'src1') THEN 'stem' WHEN source = 'src2' THEN 'humanities' ELSE 'other' END AS k, (doc_id % 4 = 2)::INT AS ok FROM documents)
SELECT k AS "group", round(avg(ok), 6) AS accuracy, count(*) AS n FROM (SELECT k, ok FROM c UNION ALL SELECT 'all', ok FROM c) GROUP BY k
""")
def category_accuracy(spark, sf_dir):
    categories = spark.createDataFrame([("src0", "stem"), ("src1", "stem"), ("src2", "humanities")], "source string, category string")
    d = table(spark, sf_dir, "documents").join(F.broadcast(categories), "source", "left")  # three rows
    said = F.when(F.col("doc_id") % 4 == 2, "So: answer : c").otherwise("Answer: A")
    return rounded(J.grouped_accuracy(d.withColumn("letter", J.letter_answer(said)), F.array(F.coalesce("category", F.lit("other"))), F.col("letter") == "C"))


@query("review_ratio", "WITH r AS (SELECT source, doc_id % 10 + 1 AS a, doc_id % 7 + 1 AS b FROM documents) SELECT source, round(avg(a), 6) AS mean_first, round(avg(b), 6) AS mean_second, round(avg(b) / avg(a) * 100) AS ratio FROM r GROUP BY 1 UNION ALL SELECT 'all', round(avg(a), 6), round(avg(b), 6), round(avg(b) / avg(a) * 100) FROM r")
def review_ratio(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 10 + 1).alias("a"), (F.col("doc_id") % 7 + 1).alias("b"))
    return rounded(J.review_ratio(r, "source", "a", "b"))


@query("choice_scoring", f"""
WITH {EMBEDDING_STEPS}, c AS (SELECT traj_id * 100 + t // 4 AS req, t % 4 AS choice, ext1[1:3 + t % 3]::DOUBLE[] AS lp FROM emb)
SELECT req, CAST(min_by(choice, (round(-(list_sum(lp) / len(lp)), 9), choice)) AS INT) AS mean_choice, CAST(min_by(choice, (round(-(list_sum(lp) / len(lp) - list_sum(lp[1:2]) / 2), 9), choice)) AS INT) AS normalized_choice FROM c GROUP BY req
""")
def choice_scoring(spark, sf_dir):
    e = embedding_steps(spark, sf_dir)
    lp = F.transform(F.slice("ext1", F.lit(1), 3 + F.col("t") % 3), lambda x: x.cast("double"))
    c = e.select((F.col("traj_id") * 100 + F.floor(F.col("t") / 4)).alias("req"), (F.col("t") % 4).cast("int").alias("choice"), lp.alias("lp")).withColumn("base", F.slice("lp", 1, 2))
    a = J.choice_by_mean(c, "req", "choice", "lp").withColumnRenamed("chosen", "mean_choice")
    return a.join(J.choice_by_mean(c, "req", "choice", "lp", "base").withColumnRenamed("chosen", "normalized_choice"), "req")


@query("choice_greedy", f"""
WITH {EMBEDDING_STEPS}, c AS (SELECT traj_id * 100 + t // 4 AS req, t % 4 AS choice, ext1[1:4]::DOUBLE[] AS lp FROM emb)
SELECT req, CAST(choice AS INT) AS chosen FROM c QUALIFY row_number() OVER (PARTITION BY req ORDER BY lp DESC, choice) = 1
""")
def choice_greedy(spark, sf_dir):
    e = embedding_steps(spark, sf_dir)
    c = e.select((F.col("traj_id") * 100 + F.floor(F.col("t") / 4)).alias("req"), (F.col("t") % 4).cast("int").alias("choice"), F.transform(F.slice("ext1", 1, 4), lambda x: x.cast("double")).alias("lp"))
    return J.choice_greedy(c, "req", "choice", "lp")


# ---------------------------------------------------------------- scans by path
@query("rollout_scan", "SELECT page_id, page_id AS episode, page_id % 3 = 0 AS success, 'pick ' || CAST(page_id % 5 AS VARCHAR) AS task FROM pages")
def rollout_scan(spark, sf_dir):
    path = F.concat(F.lit("/r/run--episode="), F.col("page_id").cast("string"), F.lit("--success="), F.when(F.col("page_id") % 3 == 0, "True").otherwise("False"), F.lit("--task=pick "), (F.col("page_id") % 5).cast("string"), F.lit(".pkl"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", *[c.alias(n) for n, c in records.rollout_fields(F.col("path")).items()])


@query("trial_scan", "SELECT page_id % 4 AS variant, count(*) AS n, round(avg(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END), 6) AS rate FROM pages WHERE contains(url, 'example') AND page_id % 5 <> 0 GROUP BY 1")
def trial_scan(spark, sf_dir):
    end = F.when(F.col("page_id") % 5 == 0, "/open").when(F.col("page_id") % 3 == 0, "/success.mp4").otherwise("/failure.mp4")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("url", end).alias("path")).where(F.col("path").contains("example"))
    scored = rows.withColumn("outcome", records.trial_outcome(F.col("path"))).where("outcome IS NOT NULL")
    return rounded(scored.groupBy((F.col("page_id") % 4).alias("variant")).agg(F.count(F.lit(1)).alias("n"), F.avg("outcome").alias("rate")))
