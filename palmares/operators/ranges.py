"""Range lookup: the label of the closed range ``lo-hi`` that holds a value.

Ranges may overlap and be of any width. They are first cut into pieces that do not overlap and are sorted by their start,
so that a value is in at most one of them. Up to ``SEARCHED`` ranges the pieces are one row, in which every value is searched by
halving; nothing is shuffled. A longer list is joined by buckets between quantiles of the starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from palmares.store import stored

#: Two numbers joined by a hyphen, whole or not.
NUMBERS = r"^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*$"
#: Ranges that are searched as one row, and quantiles that cut a longer list into buckets.
SEARCHED, BUCKETS = 1 << 12, 1 << 10


def parsed_ranges(labels: DataFrame, label: str) -> DataFrame:
    """(label, lo, hi) of every different label that is a range; a range in the wrong order raises, as it would never match."""
    bound = lambda n: F.regexp_extract(F.col(label), NUMBERS, n).cast("double")
    ranges = labels.filter(F.col(label).rlike(NUMBERS)).select(F.col(label).alias("label"), bound(1).alias("lo"), bound(2).alias("hi")).distinct()
    wrong = F.raise_error(F.concat(F.lit("not a range: "), "label")).cast("boolean")
    return ranges.filter(F.when(F.col("lo") <= F.col("hi"), F.lit(True)).otherwise(wrong))


def pieces(ranges: DataFrame) -> DataFrame:
    """(start, after, end, label): what each range holds that no earlier one does; ``after`` leaves the start itself out.

    The earlier of two ranges is the one with the smaller ``lo``, then the smaller label. Earlier ranges cover one stretch from
    ``lo`` on, up to their largest ``hi``. That is a running maximum: within range partitions, then over their maxima.
    """
    parts = stored(ranges.repartitionByRange("lo", "label").withColumn("part", F.spark_partition_id()), "ranges")
    former = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    tops = parts.groupBy("part").agg(F.max("hi").alias("top"))
    tops = tops.select("part", F.max("top").over(former().orderBy("part")).alias("before"))
    within = F.max("hi").over(former("part").orderBy("lo", "label"))
    covered = parts.withColumn("within", within).join(tops, "part").withColumn("covered", F.greatest("within", "before"))
    after = F.coalesce(F.col("covered") >= F.col("lo"), F.lit(False))
    seen = covered.filter(F.col("covered").isNull() | (F.col("hi") > F.col("covered")))
    return seen.select(F.when(after, F.col("covered")).otherwise(F.col("lo")).alias("start"), after.alias("after"), F.col("hi").alias("end"), "label")


def count_not_above(sorted_values: Column, holds, most: int) -> Column:
    """How many of at most ``most`` sorted elements meet ``holds``, a test that no element meets after one that fails it."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    size = F.size(sorted_values)
    further = lambda at, step: (at + step <= size) & holds(F.get(sorted_values, at + step - 1))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def searched(df: DataFrame, value: Column, table: DataFrame, most: int, target: str) -> DataFrame:
    """The label of every value by halving the sorted pieces, which are one row of the plan."""
    row = table.agg(F.sort_array(F.collect_list(F.struct("start", "after", "end", "label"))).alias("pieces")).scalar()
    # Functions of arrays take no subquery inside, so the pieces are a column first; every row refers to the same array.
    rows = df.withColumns({"_range_value": value, "_range_pieces": row})
    x, row = F.col("_range_value"), F.col("_range_pieces")
    at = count_not_above(row, lambda p: (p["start"] < x) | ((p["start"] == x) & ~p["after"]), most)
    found = F.get(row, at - 1)
    return rows.withColumn(target, F.when(x <= found["end"], found["label"])).drop("_range_value", "_range_pieces")


def bucketed(df: DataFrame, value: Column, table: DataFrame, target: str, buckets: int) -> DataFrame:
    """The label of every value by an equality of buckets and the range itself. A piece is in every bucket that it meets;
    as pieces do not overlap, only one of them crosses each cut, so there are fewer than ``buckets`` copies."""
    shares = [i / buckets for i in range(1, buckets)]
    cuts = table.agg(F.array_distinct(F.percentile_approx("start", F.array(*map(F.lit, shares)), F.lit(buckets * 100))).alias("cuts")).scalar()
    bucket = lambda x: count_not_above(F.col("_range_cuts"), lambda c: c <= x, buckets)
    spread = table.withColumn("_range_cuts", cuts).select("*", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("_bucket"))
    spread = stored(spread.select("_bucket", F.struct("start", "after", "end", "label").alias("_piece")), "range-buckets")
    x, piece = F.col("_range_value"), F.col("_piece")
    rows = df.withColumns({"_range_value": value, "_range_cuts": cuts}).withColumn("_value_bucket", F.when(~F.isnan("_range_value"), bucket(x))).drop("_range_cuts")
    inside = ((piece["start"] < x) | ((piece["start"] == x) & ~piece["after"])) & (x <= piece["end"])
    joined = rows.join(spread, (F.col("_value_bucket") == F.col("_bucket")) & inside, "left")
    return joined.withColumn(target, piece["label"]).drop("_bucket", "_piece", "_range_value", "_value_bucket")


def range_label(
    df: DataFrame, value: str | Column, labels: DataFrame, label: str, target: str, whole: bool = True,
    searched_ranges: int = SEARCHED, buckets: int = BUCKETS,
) -> DataFrame:
    """First ``lo-hi`` label whose closed range holds the floor of the value, or with ``whole=False`` the value, else null.

    Labels count from the smallest ``lo``, equal ones by their text. Null labels and texts that are no range are passed
    over; bounds may have fractions and lie as far apart as doubles reach. A null or NaN value has no label.
    """
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    number = F.when(F.abs(number) < float(1 << 53), F.floor(number).cast("double")).otherwise(number) if whole else number
    table = stored(pieces(parsed_ranges(labels, label)), "pieces")
    n = table.count()
    if n <= searched_ranges:
        return searched(df, number, table, max(n, 1), target)
    return bucketed(df, number, table, target, buckets)
