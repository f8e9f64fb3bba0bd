"""Connected components of a graph given by its links, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palmares.store import discard, stored


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b), root being the smallest node reachable.

    Alternating large-star and small-star rounds: each hangs neighbours under the smallest one known, and after about the
    logarithm of the longest path every node hangs under its root. Rounds are written tables; the driver reads a count
    and a checksum of each.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while seen != (seen := edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "links-low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = stored(large, "links-large")
        discard(low, edges)
        low = stored(large.groupBy("u").agg(F.min("v").alias("low")), "links-low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v")
        edges = stored(small.unionAll(low.select("u", F.col("low").alias("v"))).distinct(), "links")
        discard(low, large)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
