"""Queries that have to take all rows: long episodes in streams, whole texts, every alphabet, all steps."""

import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwright.functions import keyed
from stepwright.operators import joins, stats, verifier, windows
from stepwright.plans import registry
from stepwright.sources import storage

from compare import SF, connection, same_rows

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", ["stream_history", "stream_ensemble"])
def test_streams_keep_steps_of_long_episodes(spark, tmp_path, name):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("user_id") % 4).limit(700)
    events.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    con = connection()
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(got) == 700 and got["t"].max() >= 100
    same_rows(got, con.execute(ORACLES[name]).df())


@pytest.fixture
def documents(spark, tmp_path):
    rows = [(1, "a", "Ärger im Büro\n" + "x y " * 120 + "end\nÄrger im Büro!\närger, im büro\n2 cups-of tea"), (2, "b", "one " * 90 + "\n" + "one " * 89 + "two\ncafé 3\nCafé 3."), (3, "b", "2 Cups-of tea\nplain words\nPlain words!")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), [(d, i, t.split("\n")[0], x) for d, _, t in rows for i, x in enumerate(t.split("\n")) if i]


def test_text_similarity_of_whole_texts(spark, documents):
    folder, lines = documents
    want = {}
    for d, i, a, b in lines:
        x, y = sorted((a.strip(" ").lower(), b.strip(" ").lower()))
        want[d, i] = round(SequenceMatcher(None, x, y).ratio(), 6)
    assert {(r["doc_id"], r["pos"]): r["similarity"] for r in QUERIES["text_similarity"](spark, folder).collect()} == want


def test_alternates_of_every_alphabet(spark, documents):
    folder, lines = documents
    sets = {}
    for *_, x in lines:
        sets.setdefault(re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", x.lower())).strip(), set()).add(x)
    got = {r["key"]: (r["n"], r["first"]) for r in QUERIES["alternate_sets"](spark, folder).collect()}
    assert got == {k: (len(v), min(v)) for k, v in sets.items() if k} and len(got) == 6


def test_statistics_of_all_steps(spark):
    assert QUERIES["norm_stats_job"](spark, SF).first()["n"] == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_percentiles_of_a_group_crowded_by_an_outlier(spark):
    values = [float(i) for i in range(2000)] + [1e12, -3.5, -3.5]
    long = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)], "g string, x double")
    spans = long.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
    got = {(r["g"], r["share"]): r["value"] for r in stats.exact_percentiles(long, spans, ["g"], (0.01, 0.5, 0.99), bins=16, crowded=50).collect()}
    for q in (0.01, 0.5, 0.99):
        assert got["a", q] == pytest.approx(float(np.percentile(values, q * 100))) and got["b", q] == 7.0


def test_numbers_by_first_sight(spark):
    rows = spark.createDataFrame([(i, f"v{i * 7 % 50}") for i in range(200)], "i int, v string")
    want = {}
    for i in range(200):
        want.setdefault(f"v{i * 7 % 50}", len(want))
    assert {r["v"]: r["id"] for r in verifier.numbered_by_first(rows, "v", ["i"], "id").collect()} == want


def test_goal_before_the_window(spark):
    steps = spark.createDataFrame([("d", 1, t, 9, [float(t), float(t)], t // 4) for t in range(9)], "dataset_name string, episode_id long, t int, n int, action array<double>, goal_t int")
    for r in windows.chunk_neutral(steps, 2, 1, [True, False], "goal_t").collect():
        want = []
        for i in range(r["t"] - 1, r["t"] + 2):
            a = max(0, min(i, r["goal_t"]))
            want.append([0.0 if i > r["goal_t"] else float(a), float(a)])
        assert r["action_window"] == want, r


def test_swap_leaves_the_old_table_where_a_move_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    (tmp_path / "t.old").mkdir()
    with pytest.raises(FileExistsError):
        storage.swap(spark, spark.range(5), path)
    assert spark.read.parquet(path).count() == 3


def test_seeds_give_independent_draws(spark):
    rows = spark.range(2000).select(keyed.draw(F.col("id"), 1).alias("a"), keyed.draw(F.col("id"), 2).alias("b")).toPandas()
    assert abs(np.corrcoef(rows["a"], rows["b"])[0, 1]) < 0.1 and abs(rows["a"].mean() - 0.5) < 0.03


def test_greedy_choice_with_ended_paths(spark):
    c = spark.createDataFrame([(1, 0, [-1.0]), (1, 1, [-1.0, -3.0]), (1, 2, [-2.0]), (2, 5, [-1.0, -2.0]), (2, 4, [-1.0, -2.0])], "g int, i int, lp array<double>")
    assert {r["g"]: r["chosen"] for r in joins.choice_greedy(c, "g", "i", "lp").collect()} == {1: 0, 2: 4}
