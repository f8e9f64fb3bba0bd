"""Joins: per-group values, lookups with a default, membership.

No side is broadcast by a hint unless a LIMIT bounds it. Every other side is a file or a stored table, whose
size the planner reads before it chooses between broadcast and sort-merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from palmares.store import stored


def attach(df: DataFrame, values: DataFrame, on: Sequence[str] | str, how: str = "left", nulls: bool = False) -> DataFrame:
    """Join per-group values back to the rows of the groups; with ``nulls`` a null key is a group like any other.

    The values are stored first, which computes the aggregate once and fixes its size, so the rows are
    shuffled only when the values are too large to broadcast.
    """
    values = stored(values, "attach")
    if not nulls:
        return df.join(values, on, how)
    keys = [on] if isinstance(on, str) else list(on)
    values = values.withColumnsRenamed({k: f"_attach_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_attach_{k}")) for k in keys]
    return df.join(values, same, how).drop(*[f"_attach_{k}" for k in keys])


def lookup(
    df: DataFrame, key: str, dimension: DataFrame, dimension_key: str, value: str, target: str, default: str | None
) -> DataFrame:
    """Left lookup of one value per key. Unmatched and null keys take ``default``."""
    values = dimension.select(F.col(dimension_key).alias("_key"), F.col(value).alias("_value"))
    return (
        df.join(values, F.col(key) == F.col("_key"), "left")
        .withColumn(target, F.coalesce(F.col("_value"), F.lit(default)))
        .drop("_key", "_value")
    )


def keep_listed(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows whose key is in the list, each once however often the list repeats it."""
    return df.join(keys, on, "left_semi")


def match_listed(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows whose key is in the list, once per occurrence there."""
    return df.join(keys, on, "inner")
