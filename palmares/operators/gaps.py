"""Ordered history per entity: counts on rows, gaps between years, time to the second success.

Rows are first counted per entity and year, so the window of one entity holds one row per year however many
rows the entity has. A lag on every row runs over range partitions, so that no entity is in one task as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from palmares.operators.joins import attach
from palmares.schemas import SAME_YEAR
from palmares.store import stored


def with_group_count(df: DataFrame, key: str, target: str) -> DataFrame:
    """The number of rows of the key on each of its rows; rows without a key are counted together."""
    return attach(df, df.groupBy(key).agg(F.count(F.lit(1)).alias(target)), key, "inner", nulls=True)


def year_steps(df: DataFrame, key: str, year: str = "year") -> DataFrame:
    """Per key and year: rows ``n``, the previous year with rows ``prev_year`` and the ``gap`` to it.

    The row-wise lag of the year follows from it: the first row of a year lags to ``prev_year``, its other
    ``n - 1`` rows lag to the same year.
    """
    counts = df.groupBy(key, year).agg(F.count(F.lit(1)).alias("n"))
    previous = F.lag(year, 1).over(Window.partitionBy(key).orderBy(year))
    return counts.withColumn("prev_year", previous).withColumn("gap", F.col(year) - F.col("prev_year"))


def row_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, target: str, ties: Sequence[str] = ()) -> DataFrame:
    """``target``: the value of ``column`` on the previous row of the same key by ``order``, then ``ties``; null on the first.

    Rows are split by range of key, order and ties and stored; each range lags alone. Only the first row of a range can have
    its predecessor elsewhere, and that is the last row of the range before: one row a range is carried over. Null keys are a
    key, and null orders come first, as in a window.
    """
    by = [*keys, *order, *ties]
    parts = stored(df.repartitionByRange(*[F.asc_nulls_first(c) for c in by]).withColumn("_range", F.spark_partition_id()), "lag-ranges")
    w = Window.partitionBy("_range", *keys).orderBy(*[F.asc_nulls_first(c) for c in by[len(keys):]])
    within = parts.withColumns({"_lag": F.lag(column).over(w), "_first": F.row_number().over(w) == 1})
    last = parts.groupBy("_range").agg(F.max(F.struct(*by, F.struct(column).alias("_value"))).alias("_last"))
    # One row a range, and there are as many ranges as the shuffle has partitions.
    carried = last.select("_range", F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("_range")).alias("_last"))
    carried = stored(carried.filter(F.col("_last").isNotNull()), "lag-carried")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_last.{k}"))
    joined = within.join(carried, "_range", "left")
    value = F.when(F.col("_first") & same, F.col("_last._value").getField(column)).otherwise(F.col("_lag"))
    return joined.withColumn(target, F.when(F.col("_first") & ~same, F.lit(None)).otherwise(value)).drop("_range", "_lag", "_first", "_last")


def second_success(df: DataFrame, key: str, year: str = "year", target: str = "gap") -> DataFrame:
    """Years between the first and the second row of every key, 0 when both fall into one year, null with one row."""
    steps = year_steps(df, key, year)
    first = F.min(F.struct(F.col(year), F.col("n"))).alias("first")
    following = F.min(F.when(F.col("prev_year").isNotNull(), F.col(year))).alias("next")
    gap = F.when(F.col("first.n") > 1, F.lit(0)).otherwise(F.col("next") - F.col(f"first.{year}"))
    return steps.groupBy(key).agg(first, following).select(
        key, F.col(f"first.{year}").alias("first_year"), gap.cast("int").alias(target)
    )


def gap_label(gap: str | Column = "gap") -> Column:
    """``S.Y.`` for two successes in the same year, else the number of years as text."""
    years = F.col(gap) if isinstance(gap, str) else gap
    return F.when(years == 0, F.lit(SAME_YEAR)).otherwise(years.cast("string"))
