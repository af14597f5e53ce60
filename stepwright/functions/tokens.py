"""Actions as tokens: binning of [-1, 1] and its inverse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(bins: int) -> list[float]:
    """bins equally spaced points from -1 to 1, formed as start + i * step with the last one exact."""
    step = 2.0 / (bins - 1)
    return [*(i * step - 1.0 for i in range(bins - 1)), 1.0]


def centres(bins: int) -> list[float]:
    e = edges(bins)
    return [(a + b) / 2 for a, b in zip(e, e[1:])]


def _literals(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bin_of(x: Column, bins: int) -> Column:
    """Number of edges at or below x (1 at the lowest): a guess by arithmetic, put right against the literal edges."""
    e = _literals(edges(bins))
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    guess = F.least(F.lit(bins), F.greatest(F.lit(1), (F.floor((v + 1) / 2 * (bins - 1)) + 1).cast("int")))
    up = F.when((guess < bins) & (F.get(e, guess) <= v), guess + 1).otherwise(guess)
    return F.when(F.get(e, up - 1) > v, up - 1).otherwise(up)


def token_ids(action: Column, vocab: int = 32000, bins: int = 256, offset: int = 0) -> Column:
    return F.transform(action, lambda x: F.lit(vocab - offset) - bin_of(x, bins))


def decode_ids(ids: Column, vocab: int = 32000, bins: int = 256, offset: int = 0) -> Column:
    c = _literals(centres(bins))
    place = lambda i: F.greatest(F.lit(0), F.least(F.lit(bins - 2), F.lit(vocab - offset) - i - 1))
    return F.transform(ids, lambda i: F.get(c, place(i)))


def nearest_id(x: Column, low: Column, high: Column, vocab: int = 32000, bins: int = 256) -> Column:
    """Token of the centre nearest to an unnormalized value, the lower centre on ties; the last id but one wins over the last."""
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (x - low) / (high - low) * 2 - 1))
    step = 2.0 / (bins - 1)
    near = F.greatest(F.lit(0), F.least(F.lit(bins - 2), F.ceil((v + 1) / step - 1).cast("int")))
    return F.lit(vocab - 1) - near


def state_prompt(task: Column, state: Column, bins: int = 256) -> Column:
    """Task text and binned state (from 0) in one line."""
    binned = F.transform(state, lambda x: (bin_of(x, bins + 1) - 1).cast("string"))
    cleaned = F.replace(F.lower(F.trim(task)), F.lit("_"), F.lit(" "))
    return F.concat(F.lit("Task: "), cleaned, F.lit(", State: "), F.array_join(binned, " "), F.lit(";\n"))
