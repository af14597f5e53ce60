"""The ratio of two texts: difflib's numbers, at a fraction of its time."""

import random
import time
from difflib import SequenceMatcher

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stepwright.functions.ratios import matching_ratio
from stepwright.operators import stages

from compare import SF


def difflib_ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "etaoin shrdlu", "abcdefghijklmnopqrstuvwxyzäéß .,0123456789漢字仮名😀"])
def test_ratio_is_that_of_difflib(letters):
    """Texts of every length around the one from which frequent characters start no match; copies, repeats and others."""
    draw = random.Random(7)
    text = lambda: "".join(draw.choices(letters, k=draw.choice([0, 1, 2, 9, 70, 199, 200, 201, 430])))
    for _ in range(150):
        a = text()
        b = draw.choice([text(), "".join(c for c in a * draw.choice([1, 2]) if draw.random() < 0.9), a[::-1], a + "qz" + a])
        assert matching_ratio(a, b) == difflib_ratio(a, b), (a, b)


@pytest.mark.parametrize("a, b", [("", ""), ("", "x"), ("x", ""), ("ab", "acab"), ("xab", "abxab"), ("x y " * 120, "x y " * 90 + "end"), ("abcd" * 60, "dcba" * 60), ("q" + "a b " * 80, "a b " * 80 + "q")])
def test_ratio_of_repeats_and_empty_texts(a, b):
    assert matching_ratio(a, b) == difflib_ratio(a, b) and matching_ratio(b, a) == difflib_ratio(b, a)


def test_ratio_of_lines_takes_less_time_than_difflib():
    pairs = []
    for text in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist():
        first, *others = (text or "").lower().split("\n")
        pairs += [sorted((first, x)) for x in others]
    pairs = pairs[:: max(1, len(pairs) // 400)]

    def run(ratio):
        began = time.process_time()
        return [ratio(*p) for p in pairs], time.process_time() - began

    (want, slow), (got, fast) = run(difflib_ratio), min((run(matching_ratio) for _ in range(2)), key=lambda x: x[1])
    assert got == want and fast < slow / 2


def test_ratios_come_back_without_the_texts(spark):
    """Only one shuffle carries texts: the one that tells pairs apart."""
    rows = [(i, "pick up the cup", f"Pick up  the cup {i % 3}") for i in range(9)] + [(9, "b ", "A"), (10, "a", " B")]
    got = stages.similarity_ratios(spark.createDataFrame(rows, "id int, a string, b string"), "a", "b")
    kept = got.select("id", F.round("similarity", 6).alias("s"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (__pair" in plan and "__a" not in plan.split("Join Inner", 1)[1].split("\n", 1)[0]
    want = {i: round(difflib_ratio(*sorted((a.strip(" ").lower(), b.strip(" ").lower()))), 6) for i, a, b in rows}
    assert {r["id"]: r["s"] for r in kept.collect()} == want and got.columns == ["id", "a", "b", "similarity"]
