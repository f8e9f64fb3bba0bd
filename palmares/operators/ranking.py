"""Top-k, top-k per group, one row per key, and row numbers over a whole frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from palmares.store import stored


def top_k(counts: DataFrame, k: int, by: str = "n", ties: Sequence[str] = ()) -> DataFrame:
    """The k rows with the largest ``by``; ties are decided by the key columns in ascending order."""
    return counts.orderBy(F.desc(by), *[F.asc(c) for c in ties]).limit(k)


def top_k_per_group(
    counts: DataFrame, group: Sequence[str], k: int, by: str = "n", ties: Sequence[str] = (), rank: str = "rank"
) -> DataFrame:
    """The k largest rows of every group with their rank. Spark keeps k rows per group and task before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc(by), *[F.asc(c) for c in ties])
    return counts.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key by ``order``, then by the remaining columns.

    A minimum over structs combines on the map side, so a hot key never meets in one task as rows.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def number_rows(df: DataFrame, order: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Row numbers from 0 in the order of the whole frame, or of every group, without sorting it in one task.

    Rows are split by range and stored; each range is numbered alone and shifted by the rows of the ranges
    before it. There is one offset per range and group that meet.
    """
    spread = df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    parts = stored(spread, "ranges")
    sizes = parts.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", *by, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    return (
        parts.withColumn("_local", local)
        .join(offsets, ["_range", *by])
        .withColumn(target, F.col("_offset") + F.col("_local") - 1)
        .drop("_range", "_offset", "_local")
    )
