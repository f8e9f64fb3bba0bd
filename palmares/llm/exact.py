"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the full text.

Lengths and prefix hashes of all rows are a narrow table. Rows that are alone with their length, or with their length
and prefix, are settled there. Only the texts of the others are hashed in full: the repeated (length, prefix) pairs are
folded into a bounded set of bins that every scan can test, so that no text moves, and the bins' false positives are
sorted out by the exact grouping that follows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from palmares.llm.common import ascii_lower, text_or_empty
from palmares.store import stored

PREFIX_CHARS = 128
BINS = 1 << 17


def _seen_again(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(*keys)


def _refined(docs: DataFrame, key: str, text: str, carry: Mapping[str, Column], prefix_chars: int, bins: int):
    """The narrow table of all rows with the full hash of those that may be copies, and the groups of copies."""
    norm = ascii_lower(text_or_empty(f"`{text}`"))
    size = F.octet_length(norm).cast("long")
    prefix = F.xxhash64(F.substring(norm, 1, prefix_chars))
    light = stored(docs.select(size.alias("size"), prefix.alias("prefix")), "exact-prefix")
    same_length = light.join(stored(_seen_again(light, "size"), "exact-lengths"), "size", "left_semi")
    slot = lambda *at: F.pmod(F.xxhash64(*at), F.lit(bins)).cast("int")
    suspects = stored(_seen_again(same_length, "size", "prefix").select(slot("size", "prefix").alias("bin")).distinct(), "exact-bins")
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), norm.alias("norm"), size.alias("size"), prefix.alias("prefix"),
        *[c.alias(f"carry_{n}") for n, c in carry.items()],
    ).withColumn("bin", slot("size", "prefix"))
    hashed = rows.join(F.broadcast(suspects.withColumn("again", F.lit(True))), "bin", "left").select(
        "key", "size", "prefix", F.when(F.col("again"), F.sha2("norm", 256)).alias("full"), *[f"carry_{n}" for n in carry]
    )
    hashed = stored(hashed, "exact-full")
    each = hashed.filter(F.col("full").isNotNull()).groupBy("size", "prefix", "full", "key").agg(F.count(F.lit(1)).alias("n"))
    groups = (
        each.groupBy("size", "prefix", "full")
        .agg(F.max("key").alias("keep"), F.sum("n").alias("members"), F.max_by("n", F.struct(F.col("key").isNotNull(), "key")).alias("keepers"))
        .filter(F.col("members") > 1)
    )
    return hashed, stored(groups, "exact-groups")


def decisions(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Mapping[str, Column] | None = None,
    prefix_chars: int = PREFIX_CHARS, bins: int = BINS,
) -> DataFrame:
    """For every row its ``key``, the ``keep_id`` of the row that stays, ``group_size`` and ``kept``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest key stays. Rows that repeat
    both key and text are all marked kept (``deduplicated`` keeps one of them); a null key stays only in a group without
    other keys. ``carry`` names further columns, computed in the scan of the texts.
    """
    carry = carry or {}
    hashed, groups = _refined(docs, key, text, carry, prefix_chars, bins)
    extra = [F.col(f"carry_{n}").alias(n) for n in carry]
    alone = hashed.filter(F.col("full").isNull()).select(
        F.col("key").alias(key), F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *extra
    )
    met = hashed.filter(F.col("full").isNotNull()).join(groups, ["size", "prefix", "full"], "left")
    single = F.col("members").isNull()
    return alone.unionAll(met.select(
        F.col("key").alias(key), F.when(single, F.col("key")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("key").eqNullSafe(F.col("keep"))).alias("kept"), *extra,
    ))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS, bins: int = BINS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, with the columns of ``docs``.

    Only the identities of dropped rows are joined back. Of rows that repeat key and text one stays, whichever.
    """
    hashed, groups = _refined(docs, key, text, {}, prefix_chars, bins)
    members = hashed.filter(F.col("full").isNotNull()).join(groups, ["size", "prefix", "full"])
    dropped = stored(members.filter(~F.col("key").eqNullSafe(F.col("keep"))).select("key", "full").distinct(), "exact-dropped")
    twins = stored(groups.filter(F.col("keepers") > 1).select(F.col("keep").alias("key"), "full"), "exact-twins")
    full = F.sha2(ascii_lower(text_or_empty(f"`{text}`")), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("key"), full.alias("full"))
    same = lambda other: rows["key"].eqNullSafe(other["key"]) & (rows["full"] == other["full"])
    rows = rows.join(dropped, same(dropped), "left_anti")
    if not twins.isEmpty():
        again = rows.join(twins, same(twins), "left_semi").dropDuplicates(["key", "full"])
        rows = rows.join(twins, same(twins), "left_anti").unionAll(again)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
