"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into buckets that fit in memory, by a seeded hash. Pass two shuffles each
bucket with a seeded Fisher-Yates and writes it. Buckets one after the other are the shuffled corpus; it is cut into
shards whose numbers of rows differ by at most one.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from palmares.llm.common import packed, running_start, small, text_or_empty, unpacked
from palmares.store import stored

RECORD_BYTES = 8


def record_size(text: str = "text"):
    """UTF-8 bytes of the text, none for null, and a fixed share for the record."""
    return (F.octet_length(text_or_empty(text)) + F.lit(RECORD_BYTES)).cast("long")


def fisher_yates(n: int, seed: Sequence[int]) -> np.ndarray:
    """A uniform permutation of 0..n-1: from the last place down, swap with a drawn place at or before it."""
    draws = np.random.default_rng(seed).integers(0, np.arange(1, n + 1)) if n else np.zeros(0, np.int64)
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), draws[:0:-1].tolist()):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def external_shuffle(
    docs: DataFrame, seed: int = 17, bucket_bytes: int = 16 << 20, text: str = "text", repeats: int = 1000
) -> DataFrame:
    """All records, each with its ``bucket`` and its ``position`` in the shuffled bucket, written and read back.

    A record's bucket depends on the seed and on the record alone, so reruns agree. Records repeated over ``repeats``
    times are spread over the buckets one by one, since no hash of their content can part them; such copies are
    interchangeable. Null and empty texts are ordinary records. An empty table gives an empty table. ``bucket`` and
    ``position`` replace input columns of these names. Memory per task: one bucket, or the largest single record.
    """
    return unpacked(_shuffled(docs, seed, bucket_bytes, text, repeats), "row", ["bucket", "position"])


def _shuffled(docs: DataFrame, seed: int = 17, bucket_bytes: int = 16 << 20, text: str = "text", repeats: int = 1000) -> DataFrame:
    """(row, bucket, position): the shuffled records as structs, stored."""
    rows = docs.select(
        packed(docs.columns).alias("row"),
        F.xxhash64(F.lit(seed), F.lit(1), *[F.col(f"`{c}`") for c in docs.columns]).alias("identity"),
        record_size(text).alias("size"),
    )
    sizes = rows.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    sizes = stored(sizes, "shard-sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, ceil(total / bucket_bytes))
    often = stored(sizes.filter(F.col("n") > repeats).select("identity", F.lit(True).alias("often")), "shard-repeats")
    spread = F.when(F.col("often"), F.monotonically_increasing_id())
    scattered = rows.drop("size").join(often, "identity", "left").select(
        "row", "identity", F.pmod(F.xxhash64(F.lit(seed), F.col("identity"), spread), F.lit(buckets)).cast("long").alias("bucket")
    )
    kind = T.StructType([*scattered.select("row", "bucket").schema.fields, T.StructField("position", T.LongType())])

    def shuffle_bucket(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        drawn = np.argsort(table.column("identity").to_numpy(), kind="stable")
        drawn = drawn[fisher_yates(table.num_rows, [seed, key[0].as_py()])]
        places = pa.array(np.arange(table.num_rows), pa.int64())
        return table.select(["row", "bucket"]).take(pa.array(drawn)).append_column("position", places)

    return stored(scattered.groupBy("bucket").applyInArrow(shuffle_bucket, kind), "shuffled")


def shards(docs: DataFrame, n_shards: int = 24, **options) -> DataFrame:
    """The shuffled records with their ``shard`` (from 0, sizes at most one row apart) and gapless ``slot`` in it;
    both replace input columns of these names, all others are kept."""
    # The input row goes through as one column, so that its own bucket or position is kept.
    shuffled = _shuffled(docs, **options)
    counts = stored(shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("_rows")), "shard-counts")
    n_buckets, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    starts = stored(running_start(counts, "_rows", "bucket", "_start").select("bucket", "_start"), "shard-starts")
    each, longer = divmod(total, n_shards)
    head = longer * (each + 1)
    at = F.col("_start") + F.col("position")
    in_head, rest = at < head, at - F.lit(head)
    shard = F.when(in_head, F.floor(at / (each + 1))).otherwise(longer + F.floor(rest / max(each, 1)))
    slot = F.when(in_head, at % (each + 1)).otherwise(rest % max(each, 1))
    placed = shuffled.join(small(starts, n_buckets), "bucket").select("row", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    return unpacked(placed, "row", ["shard", "slot"])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; a row keeps its slot as a column."""
    sharded.write.partitionBy("shard").parquet(path)
