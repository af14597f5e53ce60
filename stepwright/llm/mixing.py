"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, in_order, n_words, running, stash, table

DEFAULT_WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 17


def source_targets(sized: DataFrame, weights: tuple[int, ...], max_copies: int) -> tuple[DataFrame, int]:
    """One row per source: its weight, size and target; and the budget, the size of all rows.

    Sources take the weights in turn, by code point, null last. A target is weight * level, but
    max_copies times the source's size at most; the level is where all targets sum to the budget. Each
    round of resharing sends two sums over the sources to the driver.
    """
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # code-point order is Spark's order of strings
    ordered = totals.select(F.col("source").isNull().cast("int").alias("__last"), "source", "source_size", F.lit(1).alias("__one"))
    ranked = running(ordered, [], ["__last", "source"], "__one", "__rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = stash(ranked.select("source", "source_size", weight.alias("weight")))
    budget, all_weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, fixed, open_weight = budget or 0, 0, all_weight or 0
    while True:
        level = (budget - fixed) / open_weight if open_weight else 0.0
        over = F.col("weight") * F.lit(level) >= F.col("source_size") * max_copies
        now_fixed, now_open = sources.agg(
            F.sum(F.when(over, F.col("source_size") * max_copies).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))
        ).first()
        if (now_fixed or 0, now_open or 0) == (fixed, open_weight):
            break
        fixed, open_weight = now_fixed or 0, now_open or 0
        if not open_weight:
            break
    target = F.least(F.col("weight") * F.lit(level), F.col("source_size") * float(max_copies))
    return sources.withColumn("target", F.round(target.cast("double"), 6)), budget


def shuffle_key(doc_id, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def finish_times(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Add `source_size`, `weight`, `target` and `__through`: tokens of the source up to and with the row, in shuffled order.

    Rows are range-sorted by source and shuffled key; a source's parts get the tokens of its parts before them,
    and its size, weight and target along with these, so a large source is no task's work.
    """
    order = ["__key", "doc_id", "size", "__row"]
    keyed = sized.withColumn("__last", F.col("source").isNull()).withColumn("__key", shuffle_key(F.col("doc_id"), seed))
    parted = in_order(keyed, ["__last", "source", *order])
    totals = parted.groupBy("source", "__part").agg(F.sum("size").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(F.col("source").alias("__source"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    told = starts.join(sources, F.col("__source").eqNullSafe(F.col("source"))).drop("source")
    inside = F.sum("size").over(Window.partitionBy("source", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = parted.withColumn("__inside", inside).join(told, (F.col("__part") == F.col("__p")) & F.col("source").eqNullSafe(F.col("__source")))
    return rows.withColumn("__through", F.col("__inside") + F.col("__before")).drop("__source", "__part", "__p", "__inside", "__before", "__last")


def cut_of(copies: DataFrame, budget: int, few: int = 50_000) -> DataFrame | None:
    """The last place (finish, source, key, ..., copy) that fits the budget in the global order of finish times, as a one-row table.

    All copies are range-sorted by that order and each part is summed; the part in which the budget ends is
    range-sorted again while it has more than `few` rows. None if all copies fit. The driver gets a row per part.
    """
    order = ["finish", "source_rank", "__key", "doc_id", "size", "__row", "copy"]
    inside, rows, used = copies, None, 0
    parts = max(2, int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while True:
        parted = in_order(inside, order, parts=parts)
        sums = sorted((r[0], r[1], r[2]) for r in parted.groupBy("__part").agg(F.sum("size"), F.count(F.lit(1))).collect())
        hit = None
        for part, size, n in sums:
            if used + size > budget:
                hit, held = part, n
                break
            used += size
        if hit is None:
            return None
        inside = parted.where(F.col("__part") == hit).drop("__part")
        if held <= few or held == rows:  # as few as one task sorts at ease, or rows that no order tells apart
            break
        rows = held
    place = F.struct(*order)
    summed = inside.withColumn("__sum", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    first = inside.agg(F.min(place).alias("first"))  # where nothing of this part fits, all before it does
    return summed.where(F.col("__sum") <= budget - used).agg(F.max(place).alias("cut")).join(first).select("cut", F.col("first"))


def mix(docs: DataFrame, weights: tuple[int, ...] = DEFAULT_WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs (doc_id, source, text): how often the mix takes it.

    Every document is shuffled within its source by a keyed hash and gets, for each of max_copies
    rounds through the source, a virtual finish time: tokens of the source so far divided by its weight. All copies
    are range-sorted by finish time and the order is cut where the budget, the size of all rows, is spent. So
    sources share as their weights say, and one whose rounds are used up leaves its share to the others.

    Null text has size 0 and is never taken; null sources are one source, null ids come first in shuffled
    order. Each row has its own place: repeated rows stand next to each other, and at the cut some of them may be taken once
    more than others. Equal finish times go by source, key and id. Extra columns are ignored. An empty table gives an empty
    one. `row` names a column that numbers the rows and is then returned as well.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    sized = stash(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), number.alias("__row")))
    sources, budget = source_targets(sized, weights, max_copies)
    timed = stash(finish_times(sized, sources, seed))
    rank = F.struct(F.col("source").isNull().cast("int").alias("n"), F.coalesce("source", F.lit("")).alias("s"))
    rows = timed.withColumn("source_rank", rank)

    def placed(copy) -> list:
        finish = (copy * F.col("source_size") + F.col("__through")) / F.col("weight")
        return [finish.alias("finish"), F.col("source_rank"), F.col("__key"), F.col("doc_id"), F.col("size"), F.col("__row"), copy.alias("copy")]

    each = rows.where("size > 0").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1))))
    found = cut_of(each.select(*placed(F.col("__copy"))), budget)
    if found is None:
        taken = F.lit(max_copies)
    else:
        rows = rows.join(F.broadcast(found))  # one row
        inside = [F.when(F.col("cut").isNull(), F.struct(*placed(F.lit(c))) < F.col("first")).otherwise(F.struct(*placed(F.lit(c))) <= F.col("cut")) for c in range(max_copies)]
        taken = sum((x.cast("int") for x in inside), F.lit(0))
    out = rows.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("copies"), *([F.col("__row").alias(row)] if row else []))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = DEFAULT_WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, with docs' own columns.

    Rows are numbered in a written table first, and a row meets its own count only: repeated rows are as
    many as the mix took. No name of a column is reserved. Nulls, ties and empty tables as in mix.
    """
    row, times = (free_name(docs.columns, x) for x in ("row_number", "copy_number"))
    numbered = stash(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = mix(numbered, weights, max_copies, seed, row).where("copies > 0").select(F.col(row).alias(f"_{row}"), F.col("copies").alias(f"_{times}"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    joined = numbered.join(taken, F.col(row) == F.col(f"_{row}"))
    return joined.select(*own, F.explode(F.sequence(F.lit(1), F.col(f"_{times}"))).alias(times)).select(*own)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM totals),
filled AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS full_at,
    sum(source_size) OVER () AS budget,
    coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
    sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighted),
level AS (SELECT min_by((budget - fixed) / open_weight, full_at) AS v FROM filled WHERE full_at > (budget - fixed) / open_weight),
sources AS (
  SELECT source, source_size, weight, round(least(CAST(weight AS DOUBLE) * v, CAST(3 * source_size AS DOUBLE)), 6) AS target FROM weighted, level),
timed AS (
  SELECT s.*, t.source_size, t.weight, t.target, md5('17:' || CAST(doc_id AS VARCHAR)) AS k,
    sum(size) OVER (PARTITION BY s.source ORDER BY md5('17:' || CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) AS through
  FROM sized s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, source, k, size, c, CAST(c * source_size + through AS DOUBLE) / weight AS finish
  FROM timed, (VALUES (0), (1), (2)) r(c) WHERE size > 0),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, k, doc_id, c ROWS UNBOUNDED PRECEDING) AS so_far FROM copies),
got AS (
  SELECT doc_id, count(*) AS copies FROM queue WHERE so_far <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT t.doc_id, t.size, t.source_size, t.target, CAST(coalesce(g.copies, 0) * t.size AS BIGINT) AS taken, t.source,
  CAST(coalesce(g.copies, 0) AS BIGINT) AS copies
FROM timed t LEFT JOIN got g USING (doc_id)
"""
