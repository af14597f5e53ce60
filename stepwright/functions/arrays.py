"""Vector arithmetic on array columns; all of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def clip(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def bool_mask(*runs: int) -> list[bool]:
    """Run lengths to a mask: a positive run is true, a negative one false."""
    out: list[bool] = []
    for n in runs:
        out += [n > 0] * abs(n)
    return out


def literal_mask(mask: Sequence[bool]) -> Column:
    return F.array(*[F.lit(bool(m)) for m in mask])


def pad_to(a: Column, size: int) -> Column:
    """Cut or fill with zeros to `size` elements."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), size)), 1, size)


def stride(a: Column, step: int) -> Column:
    return F.filter(a, lambda _, i: i % step == 0)


def bounded(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))
