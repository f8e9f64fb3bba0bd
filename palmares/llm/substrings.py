"""Removal of repeated byte strings of a minimum length, over a suffix array and its Burrows-Wheeler transform.

A suffix array of a whole corpus fits no task, so the corpus is cut where equal strings cannot be parted. Every string of
the minimum length is governed by one anchor, the smallest hash among its shorter substrings; equal strings have equal
anchors at equal places. The strings that one anchor governs are neighbours and form a segment. Segments whose anchor
occurs once hold nothing repeated, equal segments are repeated throughout, and only different segments of one anchor
have to be compared byte by byte.

That comparison is the transform's: the segments of some anchors are laid end to end, their suffix array gives the
transform, and breadth-first backward extension from the empty string derives the common prefixes of neighbouring
suffixes by increasing length. It stops at the minimum length: neighbours that are not told apart by then share it. An
anchor with very many different segments is settled by counting the hashes of its strings instead, which needs no task
to hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from palmares.llm.common import packed, text_or_empty, unpacked
from palmares.llm.jaccard import _bitmap, _mixed, _passes, _signed
from palmares.store import stored

LENGTH = 200
GRAM = 100
#: Different segments of one anchor that are compared in one task, and bytes of segments in a task.
SEGMENTS, SHARD_BYTES = 2048, 1 << 19
#: Texts whose segments a task holds and hands on at once.
SLICE = 1024
_LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of them."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 17, 1 << n.bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            _POWERS[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(base))]))
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Hashes:
    """Hashes of all substrings of a byte string, from sums over its prefixes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * up[:-1])])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def of_size(self, size: int) -> np.ndarray:
        """Of all substrings of one size, in order of their starts."""
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.down[:len(self.sums) - size])


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, digest, first start, last start) of every segment of a byte string; none if it is too short."""
    if len(data) < length:
        return tuple(np.zeros(0, np.uint64) for _ in range(2)) + tuple(np.zeros(0, np.int64) for _ in range(2))
    hashes = Hashes(data)
    grams = hashes.of_size(gram)
    # The upper half orders, the place in the lower half breaks ties to the left, alike in equal strings.
    keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_minimum(keyed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    anchor = at[first]
    digest = _mixed(hashes.of(first, last + length) ^ ((anchor - first).astype(np.uint64) * np.uint64(_BASE)))
    return grams[anchor], digest, first, last


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and their ranks from 0, equal for equal keys."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return order, rank


def suffix_array(codes: np.ndarray, length: int) -> np.ndarray:
    """Starts of all suffixes, sorted by at least their first ``length`` symbols: first by as many symbols as one number
    holds, then by twice as many each time."""
    bits = int(codes.max(initial=0) + 1).bit_length()
    size = max(1, 63 // bits)
    key = np.zeros(len(codes), np.int64)
    for back in range(size):
        key <<= bits
        key[:max(len(codes) - back, 0)] |= codes[back:] + 1
    order, rank = _ranked(key)
    while size < length and len(rank) and rank[order[-1]] < len(rank) - 1:
        rest = np.zeros(len(rank), np.int64)
        rest[:-size] = rank[size:] + 1
        order, rank = _ranked(rank * (len(rank) + 1) + rest)
        size *= 2
    return order


def told_apart(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For neighbours in the suffix array, whether their first ``length`` symbols differ, by backward extension.

    Two places x < y of the transform that hold the same symbol, with no such symbol between, extend to neighbours.
    These share one symbol more than the closest of the places after x up to y share. So places told apart with k symbols
    in common tell apart, with k + 1, the extensions of all such pairs that they part and that were not told apart
    before. Places are visited by increasing k, all of one k together; a place needs only the y before the next place
    told apart, since that one sees to those behind it.
    """
    last = codes[order - 1]
    by_symbol = np.argsort(last, kind="stable")
    starts = np.append(True, last[by_symbol[1:]] != last[by_symbol[:-1]])
    extended, former = np.empty(len(last), np.int32), np.full(len(last), -1, np.int32)
    extended[by_symbol] = np.arange(len(last))
    former[by_symbol[1:]] = by_symbol[:-1]
    apart = starts.copy()
    found = np.flatnonzero(starts)
    for _ in range(length - 1):
        if not len(found):
            break
        edges = np.append(np.flatnonzero(apart), len(apart))
        sizes = edges[np.searchsorted(edges, found) + 1] - found
        y = np.arange(sizes.sum()) + np.repeat(found - (np.cumsum(sizes) - sizes), sizes)
        y = y[~apart[extended[y]] & (former[y] < np.repeat(found, sizes))]
        found = extended[y]
        apart[found] = True
    return apart


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For every piece the starts of strings of ``length`` bytes that start somewhere else in the pieces too."""
    joined = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.array(list(accumulate(len(p) + 1 for p in pieces)))
    joined[ends - 1] = 0
    order = suffix_array(joined, length)
    apart = told_apart(joined, order, length)
    again = np.zeros(len(joined), bool)
    again[order] = ~apart | ~np.append(apart[1:], True)
    starts = np.concatenate([[0], ends[:-1]])
    return [np.flatnonzero(again[s:e - length]) for s, e in zip(starts, ends)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of every run of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _found_segments(rows: DataFrame, wanted: np.ndarray | None, length: int, gram: int, with_bytes: bool = False, only_anchor: bool = False) -> DataFrame:
    """Segments of all rows (row, text) whose anchor passes the screen: (anchor, digest, row, first, last), without the
    row but with its bytes once a batch, or anchors alone."""
    shared = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)
    fields = "anchor long" if only_anchor else "anchor long, digest long, bytes binary" if with_bytes else "anchor long, digest long, row long, first long, last long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for start in range(0, batch.num_rows, SLICE):
                yield read_slice(batch.slice(start, SLICE), seen)

    def read_slice(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
        ids, texts = batch.column(0).to_numpy(), batch.column(1)
        parts, pieces = [], []
        for i in range(batch.num_rows):
            data = _bytes(texts[i].as_py())
            anchor, digest, first, last = segments(data, length, gram)
            if shared is not None:
                kept = _passes(shared.value, anchor.view(np.int64))
                anchor, digest, first, last = anchor[kept], digest[kept], first[kept], last[kept]
            if with_bytes:
                for j, pair in enumerate(zip(anchor.tolist(), digest.tolist())):
                    if pair not in seen:
                        seen.add(pair)
                        pieces.append((*pair, data[first[j]:last[j] + length].tobytes()))
            else:
                parts.append((anchor, digest, np.full(len(anchor), ids[i]), first, last))
        if with_bytes:
            anchor, digest = (np.array([p[k] for p in pieces], np.uint64) for k in range(2))
            columns = [_signed(anchor), _signed(digest), pa.array([p[2] for p in pieces], pa.binary())]
        else:
            anchor, digest, row, first, last = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 5
            columns = [_signed(anchor), _signed(digest), pa.array(row), pa.array(first), pa.array(last)]
        return pa.RecordBatch.from_arrays(columns[:1] if only_anchor else columns, names=[f.split()[0] for f in fields.split(", ")][:1 if only_anchor else None])

    return rows.select("row", "text").mapInArrow(read, fields)


def _partly_repeated(pieces: DataFrame, kinds: DataFrame, length: int, limit: int, shard_bytes: int) -> DataFrame:
    """(anchor, digest, low, high): runs of starts within segments (anchor, digest, bytes) of which another one holds
    the same string; ``kinds`` counts the different segments of each anchor."""
    kind = "anchor long, digest long, low long, high long"
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    shards = max(1, ceil(total / shard_bytes))
    known = stored(pieces.join(kinds, "anchor").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))), "substring-pieces")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["anchor", "digest"])
        runs = [_runs(s) for s in repeated_starts(rows["bytes"].tolist(), length)]
        out = [(a, d, low, high) for a, d, found in zip(rows["anchor"], rows["digest"], runs) for low, high in found]
        return pd.DataFrame(out, columns=["anchor", "digest", "low", "high"]).astype("int64")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Hashes(np.frombuffer(b, np.uint8)).of_size(length) for b in batch.column(2).to_pylist()]
            sizes = np.array([len(f) for f in found], np.int64)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            both = [pa.array(np.repeat(batch.column(k).to_numpy(), sizes)) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*both, pa.array(at), _signed(np.concatenate([*found, np.zeros(0, np.uint64)]))], names=["anchor", "digest", "low", "string"])

    # Shards are small in bytes and long in seconds, so their tasks are not merged by size.
    tasks = min(shards, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    few = known.filter(F.col("kinds") <= limit).select("shard", "anchor", "digest", "bytes").repartition(tasks, "shard").groupBy("shard").applyInPandas(
        lambda rows: compare(rows), kind
    )
    many = known.filter(F.col("kinds") > limit)
    if many.isEmpty():
        return few
    each = stored(many.select("anchor", "digest", "bytes").mapInArrow(strings, "anchor long, digest long, low long, string long"), "substring-strings")
    again = stored(each.groupBy("anchor", "string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "substring-again")
    return few.unionAll(each.join(again, ["anchor", "string"]).select("anchor", "digest", "low", F.col("low").alias("high")))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = SEGMENTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(row, spans): for every row (row, text) that holds one the byte ranges covered by repeated strings, unmerged."""
    anchors = _found_segments(rows, None, length, gram, only_anchor=True).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    again = stored(anchors.filter("n > 1").select("anchor"), "substring-anchors")
    found = _found_segments(rows, _bitmap(again, "anchor"), length, gram).join(again, "anchor")
    found = stored(found, "substring-segments")
    counts = stored(found.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n")), "substring-counts")
    kinds = counts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    kinds = stored(kinds.filter((F.col("kinds") > 1) & (F.col("least") == 1)).select("anchor", "kinds"), "substring-kinds")
    pieces = _found_segments(rows, _bitmap(kinds, "anchor"), length, gram, with_bytes=True).join(kinds.select("anchor"), "anchor", "left_semi")
    pieces = stored(pieces.groupBy("anchor", "digest").agg(F.first("bytes").alias("bytes")), "substring-bytes")
    partly = stored(_partly_repeated(pieces, kinds, length, limit, shard_bytes), "substring-partly")
    placed = found.join(counts, ["anchor", "digest"])
    whole = placed.filter("n > 1").select("row", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    single = placed.filter("n = 1").join(partly, ["anchor", "digest"])
    single = single.select("row", (F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + length).alias("end"))
    return whole.unionAll(single).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges covered by the given ones."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, **options) -> DataFrame:
    """``docs`` with ``kept``, the bytes of the UTF-8 text that no repeated string covers, and ``removed``, the maximal
    removed byte ranges. Both replace columns of these names.

    A string of ``length`` bytes is repeated if it starts anywhere else, in the same text or another; matches never
    cross texts, and strings are judged on the texts as given. Null texts are empty. Rows that repeat a key are texts of
    their own, so equal texts remove each other. Only texts that may hold a repeated string are moved to their spans.
    """
    rows = docs.select(packed(docs.columns).alias("doc"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").alias("text"))
    spans = stored(repeated_spans(rows, length, gram, **options), "substring-spans")
    screen = docs.sparkSession.sparkContext.broadcast(_bitmap(spans, "row"))

    @F.pandas_udf("boolean")
    def may_repeat(row: pd.Series) -> pd.Series:
        return pd.Series(_passes(screen.value, row.to_numpy()))

    flagged = rows.withColumn("may", may_repeat("row"))
    ranges = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    clean = flagged.filter(~F.col("may")).select("doc", text_or_empty("text").cast("binary").alias("kept"), F.array().cast(ranges).alias("removed"))
    held = flagged.filter("may").join(spans, "row", "left").select("doc", "text", "spans")
    kind = T.StructType([held.schema["doc"], T.StructField("kept", T.BinaryType()), T.StructField("removed", ranges)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for i in range(batch.num_rows):
                data = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                gone = merged([(s["start"], s["end"]) for s in batch.column(2)[i].as_py() or []])
                edges = [0, *(x for pair in gone for x in pair), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append([{"start": a, "end": b} for a, b in gone])
            arrow_ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(removed, arrow_ranges)], names=["doc", "kept", "removed"])

    return unpacked(clean.unionAll(held.mapInArrow(cut, kind)), "doc", ["kept", "removed"])
