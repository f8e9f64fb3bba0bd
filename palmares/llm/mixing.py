"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

The mix is as long as the corpus and consists of equal blocks. Blocks go to sources one by one by the highest quotient
target / (2 k + 1), and shard after shard takes the next equal run of this sequence, which gives whole quotas per shard.
A source's documents, in seeded order, are an endless stream of which its blocks are cut one after the other, so no word
is taken more often than another of its source by more than one.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from palmares.llm.common import WORD, n_words, packed, running_start, unpacked
from palmares.operators.ranking import number_rows
from palmares.store import stored

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 8


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(src, source_size, rank, target) of every row (src, source_size); ``src`` sorts as the sources do.

    Targets share all words by weight and stop at ``cap`` times the source's size; what is above is shared again by
    weight until none is. Each round is one aggregate of one row, so sources never meet in one place.
    """
    ranked = number_rows(sizes, ["src"], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight), "mix-sources")
    total, free, level = *ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first(), 0.0
    most = F.col("source_size") * cap
    fixed = 0
    while free and total > fixed and (total - fixed) / free > level:
        level = (total - fixed) / free
        above = F.col("weight") * level > most
        fixed, free = ranked.agg(
            F.coalesce(F.sum(F.when(above, most)), F.lit(0)), F.sum(F.when(~above, F.col("weight")))
        ).first()
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), most.cast("double"))).drop("weight")


def _seats(quotient: float) -> Column:
    """Blocks of a source whose quotients reach the given one, at most as many as its words allow."""
    return F.least(F.floor((F.col("target") / F.lit(quotient) + 1) / 2), F.col("most"))


def quotas(targets: DataFrame, block: int = BLOCK, shards: int = 1, cap: int = CAP) -> DataFrame:
    """(src, shard, upto): blocks of every source in the shards up to and including ``shard``.

    Sainte-Laguë is house monotone, so the first K blocks of the sequence are the apportionment of K seats. For all
    shard ends at once a threshold on the quotient is bisected, each step an aggregate of one row, until no source has
    more than one quotient in doubt; the doubtful ones are then ranked, ties by the order of sources.
    """
    rows = stored(targets.withColumn("most", F.floor(F.col("source_size") * cap / block)), "mix-targets")
    total, limit, top, n = rows.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.max("target"), F.lit(0.0)), F.count(F.lit(1))
    ).first()
    house = min(round(total / block), limit)
    ends = [house * s // shards for s in range(1, shards + 1)]
    low = [max(total, 1) / (2 * k + n + 2) for k in ends]
    high = [2 * top + 1] * shards
    doubtful = house > 0
    while doubtful:
        found = rows.agg(*[F.sum(_seats(q)) for q in low]).first()
        if short := [i for i in range(shards) if found[i] < ends[i]]:
            for i in short:
                low[i] /= 2
            continue
        middle = [(a * b) ** 0.5 for a, b in zip(low, high)]
        found = rows.agg(*[F.sum(_seats(q)) for q in middle], *[F.max(_seats(a) - _seats(b)) for a, b in zip(low, high)]).first()
        doubtful = max(found[shards:]) > 1 and any(a < m < b for a, m, b in zip(low, middle, high))
        for i, m in enumerate(middle if doubtful else ()):
            low[i], high[i] = (m, high[i]) if found[i] >= ends[i] else (low[i], m)
    sure = [_seats(b) if house else F.lit(0) for b in high]
    each = rows.select("src", "rank", "target", F.posexplode(F.array(*[
        F.struct(s.alias("sure"), ((_seats(a) > s) if house else F.lit(False)).alias("doubt"), F.lit(k).alias("upto"))
        for s, a, k in zip(sure, low, ends)
    ])).alias("shard", "cut")).select("src", "rank", "shard", "cut.*", (F.col("target") / (2 * F.col("cut.sure") + 1)).alias("next"))
    each = stored(each, "mix-quotients")
    missing = each.groupBy("shard").agg((F.max("upto") - F.sum("sure")).alias("missing"))
    order = Window.partitionBy("shard").orderBy(F.desc("next"), "rank")
    more = each.filter("doubt").withColumn("place", F.row_number().over(order)).join(missing, "shard").filter("place <= missing")
    more = more.select("src", "shard", F.lit(1).alias("one"))
    return stored(each.join(more, ["src", "shard"], "left").select(
        "src", "shard", (F.col("sure") + F.coalesce("one", F.lit(0))).cast("long").alias("upto")
    ), "mix-quotas")


def plan(
    docs: DataFrame, keep: Sequence[str], seed: int = 23, weights: Sequence[int] = WEIGHTS, cap: int = CAP, block: int = BLOCK,
    shards: int = 1, key: str = "doc_id", text: str = "text", source: str = "source", bucket_rows: int = 10_000,
) -> DataFrame:
    """Every document as (row, size, source_size, target, begin, ends): the columns ``keep``, its words, its source's
    words and target, the place of its first word in its source's stream, and the words the source gives up to each shard.

    The seeded order of a source's documents depends on key and text alone, so reruns agree; rows that repeat both are
    interchangeable. Null texts have no words, a null source is a source of its own and the last one; without words all
    targets are 0. A hot source is cut into buckets of about ``bucket_rows`` rows, placed by their sums.
    """
    src = F.when(F.col(f"`{source}`").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(f"`{source}`")))
    drawn = F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`"))
    buckets = max(1, ceil(docs.count() / bucket_rows))
    rows = docs.select(
        packed(keep).alias("row"), src.alias("src"), n_words(f"`{text}`").alias("size"), drawn.alias("drawn"),
        F.pmod(drawn, F.lit(buckets)).alias("bucket"), F.col(f"`{key}`").alias("key"),
    )
    parts = stored(rows.groupBy("src", "bucket").agg(F.sum("size").alias("words")), "mix-parts")
    targets = stored(source_targets(parts.groupBy("src").agg(F.sum("words").alias("source_size")), weights, cap), "mix-shares")
    cuts = quotas(targets, block, shards, cap).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("shard", "upto"))).alias("ends"))
    given = targets.join(cuts, "src").select("src", "source_size", "target", F.transform("ends", lambda e: e["upto"] * block).alias("ends"))
    starts = stored(running_start(parts, "words", "bucket", "start", ["src"]).join(given, "src").drop("words"), "mix-starts")
    before = Window.partitionBy("src", "bucket").orderBy("drawn", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["src", "bucket"]).withColumn("begin", F.col("start") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    return placed.select("row", "size", "source_size", "target", "begin", "ends")


def taken(end: Column) -> Column:
    """Words of a document among the first ``end`` of its source's endless stream."""
    rest = F.greatest(F.least(F.col("begin") + F.col("size"), F.pmod(end, F.col("source_size"))) - F.col("begin"), F.lit(0))
    return F.when(F.col("size") > 0, F.floor(end / F.col("source_size")) * F.col("size") + rest).otherwise(0).cast("long")


def shares(docs: DataFrame, keep: Sequence[str], **options) -> DataFrame:
    """The columns ``keep`` with ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes."""
    rows = plan(docs, keep, **options).withColumn("taken", taken(F.element_at("ends", -1)))
    return unpacked(rows, "row", ["size", "source_size", "target", "taken"])


def mixed(docs: DataFrame, text: str = "text", n_chars: str | None = None, shards: int = 1, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row for each run of words that a shard takes in one pass of the
    source, with ``shard``, ``epoch``, ``first_word`` and ``n_words``. A run of all words keeps the text as it is, a
    shorter one (at most two for each source and shard) joins its words by spaces; ``n_chars`` names a column that is
    set to the new length. Documents of which nothing is taken are left out.
    """
    rows = plan(docs, docs.columns, text=text, shards=shards, **options)
    passes = F.ceil(F.element_at("ends", -1) / F.col("source_size")).cast("int")
    rows = rows.filter("size > 0").filter(F.element_at("ends", -1) > F.col("begin"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1))).withColumn("at", F.col("epoch") * F.col("source_size") + F.col("begin"))
    rows = rows.select("*", F.posexplode("ends").alias("shard", "end"))
    opened = F.when(F.col("shard") > 0, F.get("ends", F.col("shard") - 1)).otherwise(0)
    first = F.greatest(opened - F.col("at"), F.lit(0))
    rows = rows.withColumn("first_word", first).withColumn("n_words", F.least(F.col("end") - F.col("at"), F.col("size")) - F.col("first_word"))
    rows = rows.filter("n_words > 0")
    body = F.col("row").getField(text)
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    piece = F.array_join(F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    rows = rows.withColumn("piece", F.when(F.col("n_words") == F.col("size"), body).otherwise(piece))
    changed = {text: F.col("piece")} | ({n_chars: F.length("piece").cast("long")} if n_chars else {})
    added = ["shard", "epoch", "first_word", "n_words"]
    kept = [c for c in docs.columns if c not in added]
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in kept], *added)
