"""Bins over numeric columns and their text labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palmares.functions.scalar import round_even, word
from palmares.schemas import AGE_EDGES, DECADE_EDGES


def edge_labels(edges: Sequence[int]) -> list[str]:
    """``lo+1-hi`` for every pair of neighbouring edges."""
    return [f"{lo + 1}-{hi}" for lo, hi in zip(edges, edges[1:])]


def label_bounds(label: str | Column) -> tuple[Column, Column]:
    """The two integers of a ``lo-hi`` label, null where the text is not one."""
    return word(label, 0, "-").try_cast("int"), word(label, 1, "-").try_cast("int")


def bounds_label(lo: Column, hi: Column) -> Column:
    """``lo-hi`` of two integers."""
    return F.concat_ws("-", lo.cast("string"), hi.cast("string"))


def fixed_bins(
    column: str, edges: Sequence[float], labels: Sequence[str | None], closed: str = "left"
) -> Column:
    """Label of the interval that holds the value, null outside all of them.

    ``closed="left"`` gives ``[lo, hi)`` with the last interval closed on both ends, ``closed="right"`` ``(lo, hi]``.
    """
    value = F.col(column)
    last = len(edges) - 2

    def holds(i: int) -> Column:
        if closed == "right":
            return (value > edges[i]) & (value <= edges[i + 1])
        upper = value <= edges[i + 1] if i == last else value < edges[i + 1]
        return (value >= edges[i]) & upper

    branches = [(holds(i), F.lit(label)) for i, label in enumerate(labels)]
    first, *rest = branches
    return reduce(lambda c, b: c.when(*b), rest, F.when(*first))


def age_bin(column: str = "age") -> Column:
    """Left-closed age groups. The label starts one above the edge and the oldest group has no label."""
    return fixed_bins(column, AGE_EDGES, edge_labels(AGE_EDGES)[:-1] + [None])


def decade_bin(column: str = "age") -> Column:
    """Right-closed groups of ten years after a first one up to 20."""
    return fixed_bins(column, DECADE_EDGES, edge_labels(DECADE_EDGES), closed="right")


def equal_width_edges(df: DataFrame, column: str, bins: int = 8, digits: int = 2) -> DataFrame:
    """One row: the ``bins + 1`` rounded edges; the outer ones are rounded outwards, so that every value lies between.

    NaN counts as missing. Without a value the edges are null.
    """
    known = F.when(~F.isnan(column), F.col(column))
    lo, hi = F.min(known), F.max(known)
    inner = [round_even(lo + (hi - lo) / bins * i, digits) for i in range(1, bins)]
    first, last, unit = round_even(lo, digits), round_even(hi, digits), 10.0**-digits
    first = F.when(first > lo, round_even(first - unit, digits)).otherwise(first)
    last = F.when(last < hi, round_even(last + unit, digits)).otherwise(last)
    return df.agg(F.when(lo.isNotNull(), F.array(first, *inner, last)).alias("edges"))


def equal_width_bins(
    df: DataFrame, column: str, target: str, bins: int = 8, labelled: int = 7, digits: int = 2, drop: bool = True
) -> DataFrame:
    """Equal-width bins between the extremes of ``column`` with labels such as ``18.51-20.56``.

    The ``bins + 1`` edges are a one-row subquery of the plan, so nothing runs before the rows are asked for. Only the
    first ``labelled`` bins get a label; rows of the others, of null and of NaN are dropped, or kept with null when ``drop`` is
    false. A column with one single value falls into the first bin.
    """
    edges = equal_width_edges(df, column, bins, digits).scalar()
    value = F.col(column)
    # Edges that rounding has made equal hold nothing between them; the last bin is closed on both ends.
    reached = reduce(lambda n, i: n + F.when(value >= F.get(edges, F.lit(i)), 1).otherwise(0), range(bins + 1), F.lit(0))
    bin_of = F.when(F.get(edges, F.lit(0)) == F.get(edges, F.lit(bins)), F.when(value == F.get(edges, F.lit(0)), 1)).otherwise(F.least(reached, F.lit(bins)))
    start = F.get(edges, bin_of - 1)
    start = F.when(bin_of > 1, round_even(start + 10.0**-digits, digits)).otherwise(start)
    label = F.concat_ws("-", start.cast("string"), F.get(edges, bin_of).cast("string"))
    out = df.withColumn(target, F.when((bin_of >= 1) & (bin_of <= labelled) & (value <= F.get(edges, F.lit(bins))), label))
    return out.filter(F.col(target).isNotNull()) if drop else out
