"""All queries of the trajectory library and their SQL."""

from __future__ import annotations

from . import evaluation, language, mixture, numeric, recipes, sequence, stages, verifier  # noqa: F401
from .base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
