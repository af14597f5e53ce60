"""Reproducible draws: functions of a key and a seed, so retries and repartitioning change nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import scratch, written


def draw(key: Column, seed: int = 0) -> Column:
    """[0, 1) from an integer key: the first 52 bits of an MD5 of seed and key, the same in any SQL engine. Seeds are independent."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("long").cast("string")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def draw_sql(key: str, seed: int = 0) -> str:
    return f"(CAST(CAST('0x' || substr(md5('{seed}:' || CAST(CAST({key} AS BIGINT) AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52}.0)"


def hash_draw(*keys: Column, seed: int = 0) -> Column:
    """[0, 1) from any columns by XXH64."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)).cast("double") / float(1 << 53)


_PLACES = 33  # bits of a place inside a part, by monotonically_increasing_id


def numbered(df: DataFrame, order: list[str | Column], out: str = "number") -> DataFrame:
    """Add the number (from 0) of each row in the given order, which should tell rows apart.

    No window spans the table: rows are range-sorted into parts, written with their place in the part, and raised by the sizes of
    the parts before, of which there is a row each. Parts follow the data, so keys of any spread give even ones.
    """
    kept = df.columns
    ids = [f"__o{i}" for i in range(len(order))]
    keyed = df.withColumns({c: F.col(o) if isinstance(o, str) else o for c, o in zip(ids, order)})
    placed = keyed.repartitionByRange(*ids).sortWithinPartitions(*ids).withColumn("__place", F.monotonically_increasing_id())
    parted = written(placed.select(*kept, "__place"), scratch(df.sparkSession))
    part = F.shiftright("__place", _PLACES)
    sizes = parted.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))  # a row for each part
    inside = F.col("__place").bitwiseAND(F.lit((1 << _PLACES) - 1))
    return parted.withColumn("__part", part).join(F.broadcast(starts), "__part").select(*kept, (F.col("__before") + inside).cast("long").alias(out))


def ranked(df: DataFrame, unit: Column, ties: list[str], out: str = "rank") -> DataFrame:
    """Add the rank (from 1) of each row in the order (unit, *ties)."""
    return numbered(df, [unit, *ties], out).withColumn(out, F.col(out) + 1)
