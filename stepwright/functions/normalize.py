"""Normalization of action and state vectors by statistics arrays; masked dims pass through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(x: Column, a: Column, b: Column, mask: Column, f) -> Column:
    rows = F.arrays_zip(x.alias("x"), a.alias("a"), b.alias("b"), mask.alias("m"))
    return F.transform(rows, lambda r: f(r["x"], r["a"], r["b"], r["m"]))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def z_score(x: Column, mean: Column, std: Column, mask: Column, eps: float = 1e-8) -> Column:
    return _each(x, mean, std, mask, lambda v, m, s, k: F.when(k, (v - m) / (s + eps)).otherwise(v))


def to_bounds(x: Column, low: Column, high: Column, mask: Column, eps: float = 1e-8) -> Column:
    """[low, high] to [-1, 1], clipped; a dim whose low equals its high gives 0 even where the mask is false."""
    return _each(
        x, low, high, mask, lambda v, lo, hi, k: F.when(lo == hi, F.lit(0.0)).when(k, _unit((v - lo) * 2 / (hi - lo + eps) - 1)).otherwise(v)
    )


def to_quantiles(x: Column, low: Column, high: Column, mask: Column, eps: float = 1e-6) -> Column:
    """[low, high] to [-1, 1] without a clip."""
    return _each(x, low, high, mask, lambda v, lo, hi, k: F.when(k, (v - lo) / (hi - lo + eps) * 2 - 1).otherwise(v))


def from_quantiles(y: Column, low: Column, high: Column, mask: Column, eps: float = 1e-6) -> Column:
    return _each(y, low, high, mask, lambda v, lo, hi, k: F.when(k, (v + 1) / 2 * (hi - lo + eps) + lo).otherwise(v))


def from_bounds(y: Column, low: Column, high: Column, mask: Column) -> Column:
    return _each(y, low, high, mask, lambda v, lo, hi, k: F.when(k, (v + 1) * 0.5 * (hi - lo) + lo).otherwise(v))


def from_z_score(y: Column, mean: Column, std: Column, mask: Column, eps: float = 1e-6) -> Column:
    return _each(y, mean, std, mask, lambda v, m, s, k: F.when(k, v * (s + eps) + m).otherwise(v))


def proprio_bounds(x: Column, low: Column, high: Column, mask: Column, eps: float = 1e-8) -> Column:
    """As to_bounds without its rule for constant dims; masked dims are clipped too."""
    return _each(x, low, high, mask, lambda v, lo, hi, k: _unit(F.when(k, (v - lo) * 2 / (hi - lo + eps) - 1).otherwise(v)))


def shifted(chunk: Column, state: Column, mask: Column, sign: int) -> Column:
    """Each action of a chunk plus sign * state on masked dims: -1 makes actions relative, 1 absolute."""
    step = F.zip_with(state, mask, lambda s, k: F.when(k, s * sign).otherwise(F.lit(0.0)))
    return F.transform(chunk, lambda a: F.zip_with(a, step, lambda x, s: x + s))


def droid_actions(a: Column, low: Column, high: Column) -> Column:
    """Joints to [-1, 1] by quantiles, clipped; the last dim is 1 from 0.5 on, else 0."""
    joints = F.slice(a, 1, F.size(a) - 1)
    scaled = F.transform(F.arrays_zip(joints.alias("x"), low.alias("a"), high.alias("b")), lambda r: _unit((r["x"] - r["a"]) / (r["b"] - r["a"]) * 2 - 1))
    grip = F.when(F.element_at(a, -1) >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.concat(scaled, F.array(grip))
