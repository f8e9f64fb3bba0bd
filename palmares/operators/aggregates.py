"""Grouped counts, category pivots, roll-ups along a path, shares and profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palmares.schemas import MEDALS, NO_MEDAL


def won(column: str = "medal") -> Column:
    """True for a row with a medal; null counts as none."""
    return F.col(column) != NO_MEDAL


def count_by(df: DataFrame, keys: Sequence[str], counted: str | None = None, target: str = "n") -> DataFrame:
    """Rows per group, or non-null values of ``counted`` per group."""
    return df.groupBy(*keys).agg(F.count(counted if counted else F.lit(1)).alias(target))


def sum_by(df: DataFrame, keys: Sequence[str], measure: str, target: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(measure).alias(target or measure))


def category_pivot(
    df: DataFrame,
    keys: Sequence[str],
    category: str = "medal",
    values: Sequence[str] = MEDALS,
    measure: str | None = None,
    total: str = "total",
) -> DataFrame:
    """One zero-filled column per category value (its name in lower case) and their total.

    Sums ``measure``, or counts rows without one.
    """
    amount = F.col(measure) if measure else F.lit(1).cast("bigint")
    names = [v.lower().replace(" ", "_") for v in values]
    sums = [
        F.sum(F.when(F.col(category) == v, amount).otherwise(F.lit(0))).alias(n) for v, n in zip(values, names)
    ]
    return df.groupBy(*keys).agg(*sums).withColumn(total, reduce(lambda a, b: a + b, [F.col(n) for n in names]))


def most_frequent(columns: Sequence[str], labels: Sequence[str]) -> Column:
    """Label of the largest of the columns; the earlier column wins a tie."""
    top = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    first, *rest = zip(columns, labels)
    chain = F.when(F.col(first[0]) == top, F.lit(first[1]))
    return reduce(lambda c, pair: c.when(F.col(pair[0]) == top, F.lit(pair[1])), rest, chain)


def typical_category(
    df: DataFrame, keys: Sequence[str], category: str = "medal", values: Sequence[str] = MEDALS,
    measure: str | None = None, target: str = "typical_medal",
) -> DataFrame:
    """The most frequent category of every group, ties in the order of ``values``."""
    pivot = category_pivot(df, keys, category, values, measure)
    return pivot.select(*keys, most_frequent([v.lower().replace(" ", "_") for v in values], values).alias(target))


def hierarchy(
    df: DataFrame, path: Sequence[str], measure: str | None = None, target: str = "amount"
) -> DataFrame:
    """Amount at every prefix of ``path``, with ``level`` 0 for the grand total.

    The rows are summed on the whole path first, so the roll-up multiplies groups instead of rows.
    """
    leaves = sum_by(df, path, measure, "_leaf") if measure else count_by(df, path, target="_leaf")
    missing = reduce(lambda a, b: a + b, [F.grouping(c).cast("int") for c in path])
    return leaves.rollup(*path).agg(F.sum("_leaf").alias(target), (F.lit(len(path)) - missing).alias("level"))


def distinct_levels(df: DataFrame, path: Sequence[str], counted: str, target: str = "n", lg: int = 14) -> DataFrame:
    """Estimated number of different values of ``counted`` at every prefix of ``path``, with ``level`` 0 for the whole.

    Distinct counts of parts do not add up, their sketches do: the rows are read once into a sketch for each full path, of
    at most ``2 ** lg`` bytes whatever it has seen, and levels unite sketches. About two in three estimates are within one
    ``sketch_error``, almost all within three. Nulls do not count.
    """
    leaves = df.groupBy(*path).agg(F.hll_sketch_agg(counted, F.lit(lg)).alias("_sketch"))
    missing = reduce(lambda a, b: a + b, [F.grouping(c).cast("int") for c in path])
    levels = leaves.rollup(*path).agg(F.hll_union_agg("_sketch").alias("_sketch"), (F.lit(len(path)) - missing).alias("level"))
    return levels.withColumn(target, F.hll_sketch_estimate("_sketch")).drop("_sketch")


def sketch_error(lg: int = 14) -> float:
    """The relative standard error of a united sketch."""
    return 1.04 / 2 ** (lg / 2)


def exact_distinct_levels(df: DataFrame, path: Sequence[str], counted: str, target: str = "n") -> DataFrame:
    """The same counts exactly. Different values of each full path are kept first, so a hot path combines on the map side."""
    values = df.select(*path, counted).distinct()
    missing = reduce(lambda a, b: a + b, [F.grouping(c).cast("int") for c in path])
    return values.rollup(*path).agg(F.countDistinct(counted).alias(target), (F.lit(len(path)) - missing).alias("level"))


def with_root_share(tree: DataFrame, path: Sequence[str], amount: str = "amount", target: str = "share") -> DataFrame:
    """Share of every hierarchy node in the total of its own first-level branch."""
    root = path[0]
    roots = tree.filter(F.col("level") == 1).select(F.col(root).alias("_root"), F.col(amount).alias("_whole"))
    nodes = tree.filter(F.col("level") >= 1)
    return (
        nodes.join(roots, F.col(root).eqNullSafe(F.col("_root")))
        .withColumn(target, F.try_divide(amount, "_whole"))
        .drop("_root", "_whole")
    )


def share(df: DataFrame, label: str, measure: str | None = None, amount: str = "amount", target: str = "share") -> DataFrame:
    """Amount per label and its share of the whole."""
    sums = sum_by(df, [label], measure, amount) if measure else count_by(df, [label], target=amount)
    whole = sums.agg(F.sum(amount)).scalar()
    return sums.withColumn(target, F.try_divide(F.col(amount), whole))


def distinct_count_by(df: DataFrame, keys: Sequence[str], counted: str, target: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(counted).alias(target))


def yearly_profile(
    df: DataFrame,
    keys: Sequence[str] = ("year", "season", "continent"),
    athlete: str = "id",
    medal: str = "medal",
    measures: Sequence[str] = ("age", "height", "weight"),
) -> DataFrame:
    """Medals, distinct athletes and mean measures per group in one aggregation.

    A hot group holds many rows of few athletes or many athletes, so rows are first summed per athlete; the
    second step then meets one row per athlete and group.
    """
    totals = [F.count_if(won(medal)).alias("medals")]
    totals += [f(m).alias(f"_{p}_{m}") for m in measures for p, f in (("sum", F.sum), ("n", F.count))]
    per_athlete = df.groupBy(*keys, athlete).agg(*totals)
    return per_athlete.groupBy(*keys).agg(
        F.sum("medals").alias("medals"),
        F.count(athlete).alias("athletes"),
        *[F.try_divide(F.sum(f"_sum_{m}"), F.sum(f"_n_{m}")).alias(f"mean_{m}") for m in measures],
    )
