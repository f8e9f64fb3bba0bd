"""Recoding of category columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, functions as F

KEEP = object()


def recode(column: str | Column, mapping: Mapping[str, str], default: object = KEEP, null_as: str | None = None) -> Column:
    """Replace the keys of ``mapping``; other values stay (``KEEP``) or become ``default``; null becomes ``null_as``."""
    value = F.col(column) if isinstance(column, str) else column
    other = value if default is KEEP else F.lit(default)
    chain = F.when(value.isNull(), F.lit(null_as))
    chain = reduce(lambda c, kv: c.when(value == kv[0], F.lit(kv[1])), mapping.items(), chain)
    return chain.otherwise(other)


def override(column: str, key: str, key_value: str, value: str) -> Column:
    """``value`` where ``key`` equals ``key_value``, else ``column``."""
    return F.when(F.col(key) == key_value, F.lit(value)).otherwise(F.col(column))


def flag(column: str, negative: str) -> Column:
    """0 for the ``negative`` category, 1 for every other value."""
    return F.when(F.col(column) == negative, F.lit(0)).otherwise(F.lit(1))


def unflag(column: str, positive: str, negative: str) -> Column:
    """The names of a 0/1 flag."""
    return F.when(F.col(column) == 1, F.lit(positive)).otherwise(F.lit(negative))


def agreement(actual: str, predicted: str) -> Column:
    """``right`` or ``wrong`` with the actual class, for a pair of 0/1 flags."""
    verdict = F.when(F.col(actual) == F.col(predicted), F.lit("right")).otherwise(F.lit("wrong"))
    return F.concat_ws(" ", verdict, unflag(actual, "positive", "negative"))
