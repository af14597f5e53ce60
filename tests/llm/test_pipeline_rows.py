"""Stages of the pipeline on awkward rows: nulls, empty and long texts, repeats, clashing names, no rows at all."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"
CLASHES = ["row_number", "copy_number", "bad_id", "number", "group_id", "__id", "__n", "__copy", "score", "node", "key", "t1"]


@pytest.fixture(scope="module")
def table(spark):
    """Documents of the smallest table with repeated, null, empty and very long ones, a leak, and columns with names used inside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    good = docs.where(F.length("text") > 600).orderBy("doc_id").limit(3).collect()
    odd = [(None, good[0]["text"]), (None, None), (900_001, None), (900_002, ""), (900_003, good[1]["text"]), (900_003, good[1]["text"]), (900_004, " ".join(f"{good[2]['text']} {i}" for i in range(60))), (900_005, f"{good[2]['text']}\n{item}\nAnd so on.")]
    more = spark.createDataFrame([(i, t, None, None, 0) for i, t in odd], docs.schema)
    return docs.unionByName(more).withColumns({c: F.lit("x") for c in CLASHES}).repartition(3)


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_a_stage_on_awkward_rows(spark, table, name, stage):
    out = stage(spark, table, SF)
    rows = out.collect()
    assert rows
    if name != "sharding":
        assert out.columns == table.columns and all(r["row_number"] == "x" for r in rows)
    ids = collections.Counter(r["doc_id"] for r in rows)
    if name == "near_duplicates":
        assert ids[None] <= 1 and ids[900_003] + ids[None] <= 2 and max(ids.values()) == 1
        assert ids[900_001] + ids[900_002] == 1  # null and empty texts are copies of each other
    if name == "decontamination":
        assert ids[900_005] == 0 and ids[900_004] == 1 and ids[900_003] == 2 and ids[None] == 2
    if name == "source_mix":
        assert max(v for k, v in ids.items() if k not in (None, 900_003)) <= 3 and ids[900_001] == ids[900_002] == 0
    if name == "sharding":
        assert len(rows) == table.count()


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_a_stage_on_no_rows(spark, table, name, stage):
    assert stage(spark, table.limit(0), SF).count() == 0


def test_copies_of_one_row_become_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    three = docs.union(docs).union(docs)
    once, thrice = (dict(C.STAGES)["near_duplicates"](spark, d, SF) for d in (docs, three))
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(r["doc_id"] for r in thrice.collect())
