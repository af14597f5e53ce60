"""Removal of line runs that repeat earlier ones, by a suffix array over line ids."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, running, stash, table

LEAST_WORDS = 20  # words of a run that is deleted
TEXT = ["t1", "t2"]  # a text is told by 128 bits of hash, and so is a line
POSITION = [*TEXT, "line"]


def words_in(line: Column) -> Column:
    return F.coalesce(F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def two_hashes(c: Column) -> tuple[Column, Column]:
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def on(left: list[str], right: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(a) == F.col(b) for a, b in zip(left, right)])


def marked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns under names that begin with an underscore, the others as they are."""
    return df.select(*[F.col(c).alias(f"_{c}") if c in columns else F.col(c) for c in df.columns])


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """t1, t2, first (struct of the least doc_id), n, n_lines, words, lines array<struct<a, b, words>>: one row per distinct text.

    Rows of equal texts are one before anything is compared: of these the least doc_id is the first copy, all others
    are later copies as a whole.
    """

    def told(line: Column) -> Column:
        x, y = two_hashes(line)
        return F.struct(x.alias("a"), y.alias("b"), words_in(line).alias("words"))

    t1, t2 = two_hashes(whole(F.col("text")))
    made = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.transform(F.split(whole(F.col("text")), "\n"), told).alias("lines"))
    texts = made.groupBy(*TEXT).agg(F.min(F.struct("doc_id")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("lines").alias("lines"))
    return texts.withColumns({"n_lines": F.size("lines"), "words": F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["words"])})


def repeated_lines(texts: DataFrame) -> DataFrame:
    """t1, t2, line, first, n_lines, words, rank, size: the positions whose line occurs elsewhere too, with their first rank.

    rank is the number of such positions with a lesser line, so it is where the line's positions begin in the suffix array; size
    is how many there are. All other positions are told apart by their own line.
    """
    lines = stash(texts.select(*TEXT, "first", "n_lines", F.posexplode("lines").alias("line", "x")).select(*POSITION, "first", "n_lines", "x.a", "x.b", "x.words"))
    counts = stash(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    ranked = running(counts, [], ["a", "b"], "size", "upto").select(F.col("a").alias("_a"), F.col("b").alias("_b"), (F.col("upto") - F.col("size")).alias("rank"), "size")
    active = join_hot(lines, ["a", "b"], ranked, ["_a", "_b"], counts.withColumnRenamed("size", "n_rows"))
    return stash(active.select(*POSITION, "first", "n_lines", "words", "rank", "size"))


def suffix_array(active: DataFrame, longest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(array, levels) by prefix doubling over the positions of repeated lines.

    array: t1, t2, line, rank: the order of the suffixes that begin there; equal ranks are equal suffixes. levels: k and
    rank of the positions whose first 2**k lines occur elsewhere too: positions of one rank are an interval of common prefix 2**k.

    A bucket of positions that agree on 2**k lines is ordered by the ranks of the positions 2**k further: ends of texts first,
    then repeated lines by rank, then lines that occur once, each by its position. Buckets are refined by counts of
    (rank, next) pairs, range-sorted, so one of any size is no task's work; buckets of one row, and suffixes that are equal to
    their ends, are left alone. Each level has fewer open positions, and the doubling ends where all are placed, or
    where prefixes of `longest` lines are told apart: beyond that no interval is asked for.
    """
    next_ = ["kind", "ahead", "n1", "n2", "n3"]
    ranks = active.select(*POSITION, "n_lines", "rank", "size", F.lit(False).alias("ended"))
    levels = [active.select(*POSITION, F.lit(0).alias("k"), "rank")]
    for k in count():
        still = ranks.where("size > 1 AND NOT ended")
        if longest is not None and longest < 2 << k or still.isEmpty():
            return ranks.select(*POSITION, "rank"), reduce(DataFrame.unionByName, levels)
        further = marked(ranks.select(*TEXT, (F.col("line") - (1 << k)).alias("line"), F.col("rank").alias("ahead")), POSITION)
        kind = F.when(F.col("line") + (1 << k) >= F.col("n_lines"), 0).when(F.col("ahead").isNotNull(), 1).otherwise(2)
        seen = still.join(further, on(POSITION, [f"_{c}" for c in POSITION]), "left").withColumn("kind", kind)
        alone = [F.when(F.col("kind") == 2, F.col(c)).otherwise(0).cast("long").alias(n) for c, n in zip(POSITION, ("n1", "n2", "n3"))]
        seen = stash(seen.select(*POSITION, "n_lines", "rank", "kind", F.coalesce("ahead", F.lit(0)).alias("ahead"), *alone))
        pairs = seen.groupBy("rank", *next_).agg(F.count(F.lit(1)).alias("size"))
        counts = stash(pairs)
        refined = running(counts, ["rank"], next_, "size", "upto").withColumn("placed", F.col("rank") + F.col("upto") - F.col("size"))
        refined = marked(refined.select("rank", *next_, "placed", "size"), ["rank", *next_])
        moved = join_hot(seen, ["rank", *next_], refined, [f"_{c}" for c in ("rank", *next_)], counts.withColumnRenamed("size", "n_rows"))
        moved = moved.select(*POSITION, "n_lines", F.col("placed").alias("rank"), "size", (F.col("kind") == 0).alias("ended"))
        ranks = stash(ranks.where("size = 1 OR ended").unionByName(moved.withColumn("at", F.lit(k + 1)), allowMissingColumns=True))
        levels.append(ranks.where(F.col("at").eqNullSafe(k + 1) & (F.col("size") > 1) & (F.col("line") + (2 << k) <= F.col("n_lines"))).select(*POSITION, F.col("at").alias("k"), "rank"))
        ranks = ranks.drop("at")


def runs(active: DataFrame, least_words: int) -> DataFrame:
    """t1, t2, s, e: for each position the shortest run of least_words words or more that begins there, and that which ends there.

    Of any longer run each line lies in one of these: in the shortest one that ends at the line, or, near the run's begin,
    in the shortest one from its begin. Only repeated lines are counted; a run over another line repeats nowhere.
    """
    inside = Window.partitionBy(*TEXT).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    summed = active.select(*POSITION, "words", F.sum("words").over(inside).alias("through"))
    begins = F.struct((F.col("through") - F.col("words") + least_words).alias("at"), F.lit(0).alias("end"), "line")
    ends = F.struct(F.col("through").alias("at"), F.lit(1).alias("end"), "line")
    events = summed.select(*TEXT, F.explode(F.array(begins, ends)).alias("x")).select(*TEXT, "x.*")
    up = Window.partitionBy(*TEXT).orderBy("at", "end", "line").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*TEXT).orderBy(F.desc("at"), F.desc("end"), F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    begin = F.last(F.when(F.col("end") == 0, F.col("line")), ignorenulls=True).over(up)
    end = F.last(F.when(F.col("end") == 1, F.col("line")), ignorenulls=True).over(down)
    found = events.withColumns({"s": begin, "e": end})
    spans = found.select(*TEXT, F.when(F.col("end") == 0, F.col("line")).otherwise(F.col("s")).alias("s"), F.when(F.col("end") == 1, F.col("line")).otherwise(F.col("e")).alias("e"))
    return spans.where("s IS NOT NULL AND e IS NOT NULL AND e >= s").distinct()


def later_copies(spans: DataFrame, active: DataFrame, levels: DataFrame) -> DataFrame:
    """The spans whose lines also begin at an earlier position: of lesser doc_id, or further up in the text.

    A run of n lines, 2**k <= n < 2**(k + 1), is an interval of the suffix array of common prefix n, and is told by n and the
    ranks, at level k, of its first and its last 2**k lines. The earliest member of an interval stays.
    """
    k = (F.length(F.bin(F.col("e") - F.col("s") + 1)) - 1).cast("int")
    asked = spans.withColumn("k", k).withColumn("tail", F.expr("e + 1 - shiftleft(1, k)"))
    names = [*POSITION, "k"]
    head = marked(levels.withColumnRenamed("rank", "head_rank"), names)
    rest = marked(levels.withColumnRenamed("rank", "tail_rank"), names)
    both = asked.join(head, on([*TEXT, "s", "k"], [f"_{c}" for c in names])).drop(*[f"_{c}" for c in names])
    both = both.join(rest, on([*TEXT, "tail", "k"], [f"_{c}" for c in names])).drop(*[f"_{c}" for c in names])
    first = marked(active.select(*TEXT, "line", "first"), POSITION)
    placed = both.join(first, on([*TEXT, "s"], [f"_{c}" for c in POSITION]))
    interval = ["n", "head_rank", "tail_rank"]
    rows = stash(placed.select(*TEXT, "s", "e", (F.col("e") - F.col("s") + 1).alias("n"), "head_rank", "tail_rank", F.struct("first", *TEXT, "s").alias("place")))
    earliest = stash(rows.groupBy(*interval).agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    several = marked(earliest.select(*interval, "earliest"), interval)
    met = join_hot(rows, interval, several, [f"_{c}" for c in interval])
    return met.where(F.col("place") > F.col("earliest")).select(*TEXT, "s", "e")


def dropped_lines(texts: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """t1, t2, dropped array<int>: lines that belong to a run of least_words words or more with an earlier copy."""
    active = repeated_lines(texts)
    asked = stash(runs(active, least_words))
    _, levels = suffix_array(active, asked.agg(F.max(F.col("e") - F.col("s") + 1)).first()[0] or 0)
    spans = later_copies(asked, active, levels)
    furthest = marked(spans.groupBy(*TEXT, F.col("s").alias("line")).agg(F.max("e").alias("e")), POSITION)
    inside = Window.partitionBy(*TEXT).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)  # repeated lines of one text
    reached = active.select(*POSITION).join(furthest, on(POSITION, [f"_{c}" for c in POSITION]), "left").withColumn("reach", F.max("e").over(inside))
    return reached.where("reach >= line").groupBy(*TEXT).agg(F.collect_list("line").alias("dropped"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs' columns with the cleaned text, and n_lines, n_dropped.

    A line goes if it lies in a run of lines, least_words words or more in all, that repeats a run which
    begins earlier: in a row of lesser doc_id, or further up in the same text (overlaps included). The
    first copy stays. Lines are equal if 128 bits of their hashes are. Null text counts as empty and stays null; of rows
    with equal doc_id and text none is earlier. Null ids come first. A very long text is one row, its lines are spread. An empty
    table gives an empty one. No name of a column is reserved but n_lines and n_dropped, which are added.
    """
    texts = stash(distinct_texts(docs))
    dropped = marked(dropped_lines(texts, least_words), TEXT)
    told = texts.drop("lines").join(dropped, on(TEXT, [f"_{c}" for c in TEXT]), "left").select(*[F.col(c).alias(f"_{c}") for c in TEXT], "first", "n_lines", "words", "dropped")
    t1, t2 = two_hashes(whole(F.col("text")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), t1.alias("t1"), t2.alias("t2"))
    met = join_hot(rows, TEXT, told, [f"_{c}" for c in TEXT], texts.select(*TEXT, F.col("n").alias("n_rows")))
    copy = ~F.col("row.doc_id").eqNullSafe(F.col("first.doc_id"))
    gone = F.when(copy & (F.col("words") >= least_words), F.col("n_lines")).when(copy | F.col("dropped").isNull(), 0).otherwise(F.size("dropped"))
    kept = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("dropped"))
    fewer = F.transform(F.array(F.split(whole(F.col("row.text")), "\n")), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n"))[0]
    cleaned = F.when(F.col("gone") == 0, F.col("row.text")).when(F.col("gone") == F.col("n_lines"), F.lit("")).otherwise(fewer)
    columns = [cleaned.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return met.withColumn("gone", gone).select(*columns, F.col("n_lines").cast("long").alias("n_lines"), F.col("gone").cast("long").alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


ORACLE = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS line, ls[i] AS x, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)),
pairs AS (
  SELECT a.doc_id, a.line, a.words, b.doc_id AS other, a.line - b.line AS shift
  FROM lines a JOIN lines b ON a.x = b.x AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.line < a.line))),
islands AS (
  SELECT *, line - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY line) AS island FROM pairs),
covered AS (
  SELECT DISTINCT doc_id, line FROM (
    SELECT doc_id, line, sum(words) OVER (PARTITION BY doc_id, other, shift, island) AS run_words FROM islands) WHERE run_words >= 20),
kept AS (SELECT l.*, c.line IS NOT NULL AS gone FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.line = c.line)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  md5(coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS text_md5
FROM kept GROUP BY doc_id
"""
