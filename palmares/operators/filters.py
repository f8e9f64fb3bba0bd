"""Filters chosen by a user: value lists per dimension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from palmares.schemas import PREDECESSORS


def member(column: str, values: Sequence[object]) -> Column:
    """Membership by text, so that one value list may be tested against string and numeric columns alike."""
    return F.col(column).cast("string").isin([str(v) for v in values])


def _numbers(values: Sequence[object]) -> list[int | float]:
    """The values as numbers, so that the column is compared as it is and the filter reaches the scan; other text matches
    nothing."""
    found = []
    for value in values:
        try:
            number = float(value)
        except (TypeError, ValueError):
            continue
        found.append(int(number) if number.is_integer() else number)
    return found


def apply_filters(
    df: DataFrame, chosen: Mapping[str, Sequence[object]], defaults: Mapping[str, Sequence[object]] | None = None
) -> DataFrame:
    """AND of one membership test per dimension; an empty list stands for the default list.

    A dimension without a chosen and without a default list is not filtered.
    """
    defaults = defaults or {}
    for column in dict.fromkeys([*chosen, *defaults]):
        values = chosen.get(column) or defaults.get(column)
        if values:
            numeric = isinstance(df.schema[column].dataType, NumericType)
            df = df.filter(F.col(column).isin(_numbers(values)) if numeric else member(column, values))
    return df


def expand_values(
    values: Sequence[str], expansions: Mapping[str, Sequence[str]] = PREDECESSORS
) -> list[str]:
    """The values plus the further values that each of them stands for."""
    extra = [more for value in values for more in expansions.get(value, ())]
    return list(dict.fromkeys([*values, *extra]))
