"""Stages of the pipeline, each held against a plain version on its own input."""

import collections

import numpy as np

import corpus_pipeline as C
from stepwright.llm import mixing, quality

SF = "/root/testdata/sf0.001"


def shingles(t, n=5):
    w = t.encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    inputs, outputs = {}, {}
    for name, stage in C.STAGES:
        inputs[name] = docs
        docs = stage(spark, docs, SF).persist()
        outputs[name] = docs
        if name != "sharding":
            assert docs.columns == columns
    text = {r["doc_id"]: r["text"] for r in inputs["quality_classifier"].collect()}
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]

    kept = set(ids(outputs["quality_classifier"]))
    model = quality.fit(inputs["quality_classifier"], spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {i for i, t in text.items() if model.score(quality.features(t.encode())) >= 0.3}

    unique = set(ids(outputs["near_duplicates"]))
    sets = {i: shingles(text[i]) for i in kept}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert not [(a, b) for a in unique for b in unique if a < b and similar(a, b) >= 0.8]
    assert all(any(similar(i, j) >= 0.4 for j in unique) for i in kept - unique)

    clean = set(ids(outputs["decontamination"]))
    items = [shingles(r["text"], 8) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i in unique if any(len(shingles(text[i], 8) & x) >= 0.5 * len(x) for x in items)}
    assert unique - clean == leaks

    mixed = collections.Counter(ids(outputs["source_mix"]))
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(inputs["source_mix"]).collect() if r["copies"]}
    assert mixed == want and max(mixed.values()) <= 3

    rows = outputs["sharding"].collect()
    assert collections.Counter(r["doc_id"] for r in rows) == mixed
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run_gives_the_last_stage(spark):
    rows = C.run(spark, SF)
    assert rows.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and rows.count() > 0
    assert C.ORACLE_SQL is None and np.all([callable(f) for _, f in C.STAGES])
