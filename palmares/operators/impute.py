"""Filling gaps with group means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from palmares.functions.scalar import stable_mean
from palmares.operators.joins import attach
from palmares.store import stored


def group_mean(df: DataFrame, column: str, by: Sequence[str], target: str) -> DataFrame:
    return df.groupBy(*by).agg(stable_mean(column).alias(target))


def with_group_mean(df: DataFrame, column: str, by: Sequence[str], target: str, digits: int | None = None) -> DataFrame:
    """The mean of the group on each of its rows."""
    mean = group_mean(df, column, by, target)
    return attach(df, mean if digits is None else mean.withColumn(target, F.round(target, digits)), list(by))


def fill_with_group_mean(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Replace nulls of the columns by the mean of the group, null being one; a group without values stays null."""
    means = df.groupBy(by).agg(*[stable_mean(c).alias(f"_mean_{c}") for c in columns])
    out = attach(df, means, by, nulls=True)
    filled = {c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in columns}
    return out.withColumns(filled).drop(*[f"_mean_{c}" for c in columns]).select(*df.columns)


def fill_body_measures(
    df: DataFrame, by: str = "sport", height: str = "height", weight: str = "weight", drop: bool = True
) -> DataFrame:
    """Height from the mean of the group; weight from the mean of group and filled height, else of the group.

    The mean of the last step is taken over weights that the second step has already filled. All three means
    depend on the counts of (group, height, weight) only: these are counted in one pass over the rows, and the
    rows meet one join with the values that belong to (group, height). Sums are decimal, so neither the partitioning nor
    the order of the rows changes a bit of the result. Rows still incomplete are dropped.
    """
    cells = stored(df.groupBy(by, height, weight).agg(F.count(F.lit(1)).alias("n")), "cells")

    def mean(value: str):
        exact = F.col(value).try_cast("decimal(24,12)")
        total = F.sum(exact * F.col("n").cast("decimal(13,0)"))
        return F.try_divide(total.cast("double"), F.sum(F.when(exact.isNotNull(), F.col("n"))))

    heights = cells.groupBy(by).agg(mean(height).alias("_mean_height"))
    cells = cells.join(heights, by, "left").withColumn("_height", F.coalesce(F.col(height), F.col("_mean_height")))
    near = cells.groupBy(by, "_height").agg(mean(weight).alias("_near"))
    cells = cells.join(near, [by, "_height"], "left").withColumn("_weight", F.coalesce(F.col(weight), F.col("_near")))
    weights = cells.groupBy(by).agg(mean("_weight").alias("_far"))
    values = (
        cells.groupBy(by, height).agg(F.first("_height").alias("_height"), F.first("_near").alias("_near"))
        .join(weights, by, "left")
        .select(
            F.col(by).alias("_by"), F.col(height).alias("_raw"), "_height",
            F.coalesce("_near", "_far").alias("_weight"),
        )
    )
    same = (F.col(by) == F.col("_by")) & F.col(height).eqNullSafe(F.col("_raw"))
    out = (
        df.join(stored(values, "measures"), same, "left")
        .withColumns({height: F.coalesce(F.col(height), F.col("_height")),
                      weight: F.coalesce(F.col(weight), F.col("_weight"))})
        .select(*df.columns)
    )
    return out.na.drop(subset=[height, weight]) if drop else out
