"""Column order and frames of constant or renamed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def insert_after(df: DataFrame, anchor: str, name: str, column: Column) -> DataFrame:
    """Add a column directly behind ``anchor``."""
    at = df.columns.index(anchor) + 1
    return df.select(*df.columns[:at], column.alias(name), *df.columns[at:])
