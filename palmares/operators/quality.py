"""Null profiles, removal reports and key coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: null count, not-null count and percentage of nulls, from a single pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns])
    profile = F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col("_rows") - F.col(c)).alias("n_null"), F.col(c).alias("n_not_null"))
        for c in columns
    ])
    return counts.select("_rows", F.inline(profile)).select(
        "column", "n_null", "n_not_null", F.try_divide(F.col("n_null") * 100, F.col("_rows")).alias("pct_null")
    )


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(keys))


def drop_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows before, rows after ``drop_null_keys`` and rows removed, from a single pass."""
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("before"), F.count_if(complete).alias("after")).withColumn(
        "removed", F.col("before") - F.col("after")
    )


def non_null_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), prefix: str = "n_") -> DataFrame:
    """Non-null count of every column, over all rows or per group."""
    return df.groupBy(*by).agg(*[F.count(c).alias(f"{prefix}{c}") for c in columns])


def missing_keys(df: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """Fact keys the dimension lacks, with their row counts; the rows are counted per key before the join."""
    counts = df.groupBy(F.col(key).alias("missing_key")).agg(F.count(F.lit(1)).alias("n"))
    known = dimension.select(F.col(dimension_key).alias("missing_key"))
    return counts.join(known, "missing_key", "left_anti")


def covers(df: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """One row: number of distinct fact keys, how many the dimension lacks, and whether it holds them all."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = dimension.select(F.col(dimension_key).alias(key)).distinct().withColumn("_known", F.lit(1))
    return counts.join(known, key, "left").agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("_known").isNull()).alias("n_missing"),
    ).withColumn("complete", F.col("n_missing") == 0)
