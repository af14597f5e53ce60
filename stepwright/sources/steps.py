"""Step tables: one row per timestep of an episode, t dense from 0.

Any table becomes a step table through `to_steps`; the adapters below do so for the driver's tables
(FIXTURES.md says which stands for what).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPISODE = ["dataset_name", "episode_id"]
STEP_COLUMNS = ("dataset_name", "episode_id", "t", "n", "action", "proprio", "language_instruction")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episode_window(order: str = "t"):
    """The one window specification of all sequence operators, so they share an exchange and a sort."""
    return Window.partitionBy(*EPISODE).orderBy(order)


def whole_episode():
    return Window.partitionBy(*EPISODE)


def to_steps(df: DataFrame, dataset: Column, episode: Column, order: Sequence[str | Column], action: Sequence[Column], text: Column, proprio: Sequence[Column] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Steps with dense t in the given order and n, the episode's length. Without proprio it is one zero."""
    w = Window.partitionBy("dataset_name", "episode_id")
    state = F.array(*proprio) if proprio else F.array(F.lit(0.0))
    named = df.withColumns({"dataset_name": dataset, "episode_id": episode.cast("long")})
    return named.select(
        "dataset_name",
        "episode_id",
        (F.row_number().over(w.orderBy(*order)) - 1).cast("int").alias("t"),
        F.count(F.lit(1)).over(w).cast("int").alias("n"),
        F.array(*[a.cast("double") for a in action]).alias("action"),
        state.alias("proprio"),
        text.alias("language_instruction"),
        *keep,
    )


def renumbered(steps: DataFrame) -> DataFrame:
    """t dense from 0 again and n counted again, after rows were dropped."""
    return steps.withColumn("t", (F.row_number().over(episode_window()) - 1).cast("int")).withColumn("n", F.count(F.lit(1)).over(whole_episode()).cast("int"))


# ---------------------------------------------------------------- adapters
def event_steps(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """Episodes of users: action (value, k / 99); the second dim is a gripper from 0 to 1."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double") / 99)
    dataset = F.col("event_type") if by_type else F.lit("events")
    return to_steps(events, dataset, F.col("user_id"), ["ts", "event_id"], [F.col("value"), F.col("k")], F.col("event_type"), [F.col("k"), F.col("value") / 2], ["event_id", "event_type"])


EVENT_STEPS = """
steps AS (
  SELECT 'events' AS dataset_name, user_id AS episode_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS t,
    CAST(count(*) OVER (PARTITION BY user_id) AS INT) AS n,
    value AS a0, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 99 AS a1,
    event_type AS text, event_id, event_type, ts
  FROM events)
"""

TYPED_STEPS = """
steps AS (
  SELECT event_type AS dataset_name, user_id AS episode_id,
    CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS INT) AS t,
    CAST(count(*) OVER (PARTITION BY event_type, user_id) AS INT) AS n,
    value AS a0, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 99 AS a1,
    event_type AS text, event_id, event_type, ts
  FROM events)
"""

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def line_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of orders with four-dim actions; dataset is the return flag's table as a whole."""
    lines = table(spark, sf_dir, "lineitem")
    action = [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return to_steps(lines, F.lit("lines"), F.col("l_orderkey"), _LINE_ORDER, action, F.col("l_returnflag"), None, ["l_linestatus", "l_returnflag", "l_partkey"])


LINE_STEPS = f"""
steps AS (
  SELECT 'lines' AS dataset_name, l_orderkey AS episode_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)}) - 1 AS INT) AS t,
    CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS n,
    l_quantity AS a0, l_extendedprice AS a1, l_discount AS a2, l_tax AS a3, l_returnflag AS text, l_linestatus, l_returnflag, l_partkey
  FROM lineitem)
"""


def embedding_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of labels: three views per step (a vector and the two after it) and a camera bitmask."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("traj_id"), "vec_id", "embedding")
    w = Window.partitionBy("traj_id").orderBy("vec_id")
    out = e.select("traj_id", "vec_id", (F.row_number().over(w) - 1).cast("int").alias("t"), F.col("embedding").alias("ext1"), F.lead("embedding", 1).over(w).alias("ext2"), F.lead("embedding", 2).over(w).alias("wrist"))
    mask = F.lit(1) + F.col("ext2").isNotNull().cast("int") * 2 + F.col("wrist").isNotNull().cast("int") * 4
    return out.withColumn("cameras_avail", mask)


EMBEDDING_STEPS = """
emb AS (
  SELECT CAST(label AS BIGINT) AS traj_id, vec_id,
    CAST(row_number() OVER w - 1 AS INT) AS t, embedding AS ext1, lead(embedding, 1) OVER w AS ext2, lead(embedding, 2) OVER w AS wrist
  FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
views AS (
  SELECT *, 1 + 2 * (ext2 IS NOT NULL)::INT + 4 * (wrist IS NOT NULL)::INT AS cameras_avail FROM emb)
"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rollout: condition, success, ordered scores (0: missing), lengths."""
    steps = event_steps(spark, sf_dir)
    score = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("action")[0])
    rows = steps.groupBy("episode_id").agg(
        F.max((F.col("event_type") == "purchase").cast("int")).alias("purchases"),
        F.sort_array(F.collect_list(F.struct("t", score.alias("score")))).alias("s"),
        F.max("n").alias("n"),
    )
    count = F.size(F.filter("s", lambda x: x["score"] > 60))
    return rows.select(
        "episode_id",
        F.concat(F.lit("rephrase_"), (F.col("episode_id") % 4).cast("string")).alias("condition"),
        F.when(count > F.col("n") * 0.25, 1).otherwise(0).alias("success"),
        F.transform("s", lambda x: x["score"]).alias("score_list"),
        "n",
    )


ROLLOUTS = (
    EVENT_STEPS
    + """,
rollout_steps AS (
  SELECT episode_id, 'rephrase_' || CAST(episode_id % 4 AS VARCHAR) AS condition, t, n, a0, a1,
    CASE WHEN event_type = 'error' THEN 0.0 ELSE a0 END AS score FROM steps),
rollouts AS (
  SELECT episode_id, any_value(condition) AS condition, any_value(n) AS n,
    CASE WHEN count(*) FILTER (WHERE score > 60) > any_value(n) * 0.25 THEN 1 ELSE 0 END AS success
  FROM rollout_steps GROUP BY episode_id)
"""
)


def rephrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(suite, original, pos, rephrase): the first line of a document and its other lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("suite"), F.split("text", "\n").alias("ls"))
    return lines.select("doc_id", "suite", F.col("ls")[0].alias("original"), F.posexplode("ls").alias("pos", "rephrase")).where("pos > 0")


REPHRASES = """
rephrases AS (
  SELECT doc_id, source AS suite, string_split(text, chr(10))[1] AS original, CAST(i - 1 AS INT) AS pos, string_split(text, chr(10))[i] AS rephrase
  FROM (SELECT *, unnest(range(2, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
"""
