"""Quality rules as a bitmask ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, stash, table

#: Bit of each rule in a ledger's `failed`; a ledger stays readable while bits are only added.
RULES = ("few_words", "repeated_words", "long_words", "short_words", "symbols", "repeated_lines", "bullets", "cut_lines")
#: Named sets of rules that decide; every version remains available.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "long_words", "short_words", "symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_words", "long_words", "short_words", "symbols", "repeated_lines", "bullets", "cut_lines"),
}
VERSION = 2  # of RULES and their thresholds, told in every ledger row
SYMBOLS = "#*$%&|<>"


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row: a lambda's variable is bound, a repeated expression is not."""
    return F.transform(F.array(value), use)[0]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text, each taken once; no row is exploded and nothing is shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("__text"))
    words = F.filter(F.split("__text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("__text", "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")

    def in_repeats(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    def covered(h: Column) -> Column:
        # equal windows are neighbours once sorted
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def found(s: Column) -> Column:
            equal = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: equal(x, i - 1) | equal(x, i + 1))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return let(placed, found)

    counted = let(words, lambda w: F.struct(F.size(w).alias("n_words"), in_repeats(w).alias("n_repeat_words")))
    bullets = lambda x: F.size(F.filter(x, lambda v: F.substring(v, 1, 2).isin("- ", "* ", "\u2022 ")))
    cut = lambda x: F.size(F.filter(x, lambda v: F.endswith(v, F.lit("...")) | F.endswith(v, F.lit("\u2026"))))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"), bullets(x).alias("n_bullets"), cut(x).alias("n_cut_lines")))
    length = F.length("__text")
    rows = base.select(
        "doc_id",
        counted.alias("w"),
        line_counts.alias("l"),
        F.length(F.translate("__text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    long = lambda c: F.col(c).cast("long").alias(c.split(".")[-1])
    return rows.select("doc_id", long("w.n_words"), "word_chars", "n_symbols", long("l.n_lines"), long("l.n_dup_lines"), long("l.n_bullets"), long("l.n_cut_lines"), long("w.n_repeat_words"))


def failures() -> dict[str, Column]:
    """Each rule as a test of the measurements, in whole numbers; true is a failure."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "few_words": n < 50,
        "repeated_words": F.col("n_repeat_words") * 100 > n * 50,
        "long_words": chars > n * 15,
        "short_words": chars < n * 2,
        "symbols": F.col("n_symbols") * 100 > n * 30,
        "repeated_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * 60,
        "bullets": F.col("n_bullets") * 100 > F.col("n_lines") * 90,
        "cut_lines": F.col("n_cut_lines") * 100 > F.col("n_lines") * 30,
    }


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements, `failed`, in which bit i is set if the row fails the rule RULES[i], and the rules' `version`.

    Every rule is evaluated once on every whole text, however long. Null and empty texts have no words and fail
    `few_words`. Repeated rows have a ledger row each; extra columns are ignored. An empty table gives an empty ledger.
    """
    tests = failures()
    failed = F.lit(0).cast("long")
    for bit, name in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(tests[name], F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failed", failed).withColumn("version", F.lit(VERSION))


def mask_of(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def decide(ledger_rows: DataFrame, policy: str, out: str = "kept") -> DataFrame:
    """Add `out`: true where no rule of the policy failed. The rules are not run again."""
    return ledger_rows.withColumn(out, F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablations(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """rule, failed_rows, only_this_rule: rows that fail each rule of a policy, and that it alone rejects.

    Rows are first counted by their failure bits (2**len(RULES) groups at most); the rest is bit
    arithmetic on those counts.
    """
    mask = mask_of(policy)
    counts = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    each = counts.select("bits", "n", rules).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed_rows"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("only_this_rule"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored; both policies are then read off its bits."""
    stored = stash(ledger(table(spark, sf_dir, "documents")))
    rows = decide(decide(stored, "base", "__base"), "v2")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("__base")).alias("base_failed"), "kept", "failed")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, and rejects alone, by bit arithmetic on a stored ledger of all documents."""
    return ablations(stash(ledger(table(spark, sf_dir, "documents"))), "v2")


MEASURED = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
keyed AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM windows),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1),
spots AS (SELECT DISTINCT doc_id, i + o AS p FROM twice, (VALUES (0), (1), (2)) t(o)),
rep AS (SELECT doc_id, count(*) AS n FROM spots GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    len(list_filter(ls, lambda x: x[1:2] IN ('- ', '* ', chr(8226) || ' '))) AS n_bullets, len(list_filter(ls, lambda x: ends_with(x, '...') OR ends_with(x, chr(8230)))) AS n_cut,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (n_repeat_words * 100 > n_words * 50)::INT + 4 * (word_chars > n_words * 15)::INT
    + 8 * (word_chars < n_words * 2)::INT + 16 * (n_symbols * 100 > n_words * 30)::INT + 32 * (n_dup_lines * 100 > n_lines * 60)::INT
    + 64 * (n_bullets * 100 > n_lines * 90)::INT + 128 * (n_cut * 100 > n_lines * 30)::INT AS BIGINT) AS failed
  FROM m)
"""

ORACLE = MEASURED + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

ABLATIONS = MEASURED + ", ".join(f"({1 << i}, '{r}')" for i, r in enumerate(RULES)).join(
    (", r(bit, rule) AS (VALUES ", ") SELECT rule, CAST(count(*) FILTER (WHERE failed & bit <> 0) AS BIGINT) AS failed_rows, CAST(count(*) FILTER (WHERE failed = bit) AS BIGINT) AS only_this_rule FROM f, r GROUP BY rule")
)
