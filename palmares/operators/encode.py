"""Encoding of categories and scaling of numbers as model features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from palmares.operators.ranking import number_rows
from palmares.store import stored


def _numbered(df: DataFrame, targets: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """Number the values of each text column from 0 by their smallest ``order``, then alphabetically.

    The values of all columns are collected in one pass as (column, value) pairs and numbered together.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).alias("_value")) for c in targets])
    values = (
        df.select(F.struct(*order, F.lit(0)).alias("_order"), F.inline(pairs))
        .filter(F.col("_value").isNotNull())
        .groupBy("_column", "_value")
        .agg(F.min("_order").alias("_first"))
    )
    numbers = stored(number_rows(values, ["_first", "_value"], "_at", by=["_column"]).drop("_first"), "numbers")
    for column, target in targets.items():
        index = numbers.filter(F.col("_column") == column).select(F.col("_value").alias(column), F.col("_at").alias(target))
        df = df.join(index, column, "left")
    return df


def label_index(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """For each text column its position among the distinct values in alphabetical order, from 0; null stays null.

    ``targets`` maps the columns to the names of their positions.
    """
    return _numbered(df, targets, ())


def first_seen_index(df: DataFrame, targets: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """For each text column the position of its value by first appearance in the order of the frame, from 0."""
    return _numbered(df, targets, order)


def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Columns with mean 0 and population standard deviation 1 added; a constant column becomes 0."""
    stats = df.agg(F.struct(*[
        f(c).alias(f"{p}_{c}") for c in columns for p, f in (("mean", F.avg), ("sd", F.stddev_pop))
    ])).scalar()

    def scaled(c: str):
        sd = stats[f"sd_{c}"]
        return (F.col(c) - stats[f"mean_{c}"]) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)

    return df.withColumns({f"{c}{suffix}": scaled(c) for c in columns})


def features(df: DataFrame, inputs: Sequence[str], label: str, target: str = "features") -> DataFrame:
    """Feature vector and label; rows with a null input are left out of the matrix."""
    return VectorAssembler(inputCols=list(inputs), outputCol=target, handleInvalid="skip").transform(
        df.withColumn("label", F.col(label).cast("double"))
    )
