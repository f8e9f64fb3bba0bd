"""Quality by the perplexity of an interpolated modified Kneser-Ney model of word n-grams, trained on trusted texts.

An n-gram that a model has seen multiplies the probability that backing off would give it by a factor of its own, and a
context that it has seen multiplies all of them by its weight. So the logarithm of a text's probability is a sum over its
n-grams of all orders: ``log1p(share / (weight * p of the rest))`` of each seen n-gram, the logarithm of the weight of each
seen context, and the share of unseen symbols once a symbol. Nothing needs to be asked twice, whatever was seen.

All this but one number lies at the symbol before the last, the pivot: the n-gram (x, y, z), its context (x, y), the pair
(y, z) and its context y. The remaining number, that of the symbol z itself, is the next n-gram's pivot's. So n-grams are
dealt over shards by their pivot, and one join of the documents' n-grams with the counts settles all orders. The rows of a
pivot with many n-grams are dealt over several shards by the symbol before it; its pairs are copied to each of these.

Rows of a shard travel as packed arrays: symbols sorted by hash as differences, n-grams as places in that list, sorted by
pivot. Documents are scored in rounds by hash, and the shuffle files of a round go when its sums are written. The model
stays in stored tables; nothing in this module collects it. Each language has a model, and a threshold: a quantile of the
perplexities of trusted documents that the model has not seen.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palmares.llm.common import gives_back, n_words, packed, unpacked
from palmares.llm.jaccard import word_hashes
from palmares.store import BATCH_BYTES, discard, discard_part, narrow_batches, shuffles_dropped, stored

ORDER = 3
QUANTILE = 0.995
#: One trusted text in so many is kept from the model, and thresholds come from these.
MEASURED = 4
#: Symbols whose n-grams a task lays out and sorts at once.
SHARD_ROWS = 1 << 20
#: Documents are scored in so many rounds.
ROUNDS = 8
#: Rows of documents' n-grams that are looked up at once, if they come in smaller pieces.
LOOKED_UP = 1 << 16
#: A pivot with over so many shards' n-grams is dealt over several; at most so many pivots are.
CROWDED, MOST_CROWDED = 4.0, 64
#: One trusted text in so many is counted to find those pivots. Only where rows lie depends on it.
LOOKED_AT = 16
#: Rows of a shard that are held before equal ones are summed.
HELD_ROWS = 1 << 22
START, END = 2, 3
#: Stands behind the end of a text, so that the end is a pivot too.
PAST = np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
HALF, LOW = np.uint64(32), np.uint64((1 << 32) - 1)
#: The share of a symbol in a language that the model lacks.
NO_MODEL = 1e-6

#: What a row holds: n-grams with counts; pairs; symbols with their numbers of left neighbours, asked, answered and own;
#: the list of crowded pivots; sums for the discounts; n-grams of documents.
GRAMS, PAIRS, ASKED, ANSWERED, OWN, PIVOTS, SUMS, WANTED = range(8)
ROWS = "shard int, kind int, source int, data binary"
Row = tuple[int, int, int, bytes]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


#: The symbols of a text, and how many there are as a column: code points, or 64-bit hashes of lower-cased words.
Symbols = tuple[Callable[[str], np.ndarray], Callable[[str], Column]]
CHARACTERS: Symbols = (_codes, lambda text: F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long"))
WORDS: Symbols = (word_hashes, lambda text: n_words(f"`{text}`"))


def _step(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The key of a string that is longer by one symbol, from the key of its rest."""
    key = (key ^ symbol) * MIX
    return key ^ (key >> np.uint64(29))


def _language(lang: str | None) -> np.uint64:
    key = np.zeros(1, np.uint64) + np.uint64(1)
    for code in _codes("?" if lang is None else "=" + lang):
        key = _step(key, code)
    return key[0]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, compressed with their bytes of equal weight side by side."""
    sizes, parts = [], []
    for a in arrays:
        a = np.ascontiguousarray(a, np.uint64)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        sizes += [len(a), width]
        parts.append(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = b"".join([np.array([len(sizes), *sizes], np.uint64).tobytes(), *parts])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), np.uint8)
    at = 8 + 8 * int(raw[:8].view(np.uint64)[0])
    out = []
    for size, width in raw[8:at].view(np.uint64).reshape(-1, 2).tolist():
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = raw[at:at + size * width].reshape(width, size).T
        out.append(wide.view(np.uint64).reshape(-1))
        at += size * width
    return out


class Grams(NamedTuple):
    """Different n-grams: sorted symbols, the language of each, and for each position the places of the n-grams' symbols
    among them, sorted by these: pivot, the symbols before it from near to far, the last symbol. ``more`` are numbers of each."""

    symbols: np.ndarray
    of: np.ndarray
    columns: list[np.ndarray]
    more: list[np.ndarray]

    def cut(self, start: int, end: int) -> Grams:
        """Some of the rows, with the symbols that occur in them."""
        columns = np.stack([c[start:end] for c in self.columns])
        if columns.size * 8 < len(self.symbols):
            kept, places = np.unique(columns, return_inverse=True)
            columns = places.reshape(columns.shape)
        else:
            there = np.zeros(len(self.symbols), bool)
            there[columns] = True
            kept, columns = np.flatnonzero(there), (np.cumsum(there) - 1)[columns]
        return Grams(self.symbols[kept], self.of[kept], list(columns), [m[start:end] for m in self.more])

    def pack(self, *others: np.ndarray) -> bytes:
        seeds, of = np.unique(self.of, return_inverse=True)
        first = np.diff(self.columns[0], prepend=0)
        gaps = np.diff(self.symbols, prepend=np.uint64(0))
        return _pack(seeds, gaps, of, first, *self.columns[1:], *self.more, *others)

    @classmethod
    def read(cls, data: bytes, span: int) -> Grams:
        seeds, gaps, of, first, *rest = _unpack(data)
        columns = [np.cumsum(first, dtype=np.uint64), *rest[:span - 1]]
        return cls(np.cumsum(gaps, dtype=np.uint64), seeds[of.view(np.int64)], [c.view(np.int64) for c in columns], rest[span - 1:])


def _sorted_by(columns: Sequence[np.ndarray], size: int) -> np.ndarray:
    """The order of rows by columns of numbers below ``size``."""
    bits = max(1, int(size - 1).bit_length())
    if bits * len(columns) > 64:
        return np.lexsort(columns[::-1])
    return np.argsort(reduce(lambda key, c: (key << np.uint64(bits)) | c, [c.astype(np.uint64) for c in columns]))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return new


def _arranged(grams: Grams) -> Grams:
    """The same n-grams, sorted."""
    order = _sorted_by(grams.columns, len(grams.symbols))
    return Grams(grams.symbols, grams.of, [c[order] for c in grams.columns], [m[order] for m in grams.more])


def _merged(parts: Sequence[Grams]) -> Grams:
    """All n-grams of the parts, sorted, with their numbers summed over equal ones."""
    symbols, first = np.unique(np.concatenate([p.symbols for p in parts]), return_index=True)
    of = np.concatenate([p.of for p in parts])[first]
    places = [np.searchsorted(symbols, p.symbols) for p in parts]
    columns = [np.concatenate([at[p.columns[i]] for at, p in zip(places, parts, strict=True)]) for i in range(len(parts[0].columns))]
    grams = _arranged(Grams(symbols, of, columns, [np.concatenate([p.more[0] for p in parts])]))
    if not len(columns[0]):
        return grams
    new = np.flatnonzero(_starts(*grams.columns))
    return Grams(symbols, of, [c[new] for c in grams.columns], [np.add.reduceat(grams.more[0], new)])


def _place(symbols: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a pivot; larger symbols lie in later shards."""
    return ((symbols >> HALF) * np.uint64(shards)) >> HALF


def _shards(grams: Grams, shards: int, pivots: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The shard of each n-gram. ``pivots`` are crowded, and each of them is dealt over ``parts`` shards."""
    at = _place(grams.symbols, shards)[grams.columns[0]]
    if len(pivots) and len(grams.columns) > 2:
        own = grams.symbols[grams.columns[0]]
        where = np.minimum(np.searchsorted(pivots, own), len(pivots) - 1)
        split = np.where(pivots[where] == own, parts[where], np.uint64(1))
        at = (at + _place(grams.symbols[grams.columns[1]], split)) % np.uint64(shards)
    return at.astype(np.int64)


def _pieces(at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of equal values."""
    edges = [*np.flatnonzero(_starts(at)).tolist(), len(at)] if len(at) else []
    for start, end in zip(edges, edges[1:], strict=False):
        yield int(at[start]), start, end


def _batch(rows: Sequence[Row]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "kind", "source", "data"])


def _batches(rows: Iterable[Row]) -> Iterator[pa.RecordBatch]:
    """Batches of over ``BATCH_BYTES`` of data, and the rest."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[Row]]]:
    """Sorted rows by shard; only the batch at hand is in memory."""
    rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
    return groupby(rows, key=itemgetter(0))


def _dealt(rows: DataFrame, shards: int, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], out: str = ROWS) -> DataFrame:
    """What the task makes of the rows of each shard, by kind and source."""
    rows = rows.select("shard", "kind", "source", "data").repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "source")
    return rows.mapInArrow(gives_back(task), out)


def _texts(docs: DataFrame, text: str, lang: str, own: Column, pivots: DataFrame | None = None) -> DataFrame:
    rows = docs.select(own.alias("own"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    return rows if pivots is None else rows.join(F.broadcast(pivots), F.lit(True), "left")


def _runs(batches: Iterator[pa.RecordBatch], read: Callable[[str], np.ndarray], most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, bytes | None]]:
    """(symbols of each text, languages, owns, crowded pivots) of texts with ``most`` symbols together, or of a longer one."""
    waiting, total, pivots = [], 0, None
    for batch in batches:
        if batch.num_columns > 3 and batch.num_rows and pivots is None:
            pivots = batch.column(3)[0].as_py()
        langs, owns = batch.column(1).to_pylist(), batch.column(0).to_numpy().view(np.uint64)
        seeds = {name: _language(name) for name in set(langs)}
        for i, text in enumerate(batch.column(2)):
            if not (text := text.as_py()) or not len(found := read(text)):
                continue
            if waiting and total + len(found) > most:
                yield [w[0] for w in waiting], *(np.array([w[k] for w in waiting], np.uint64) for k in (1, 2)), pivots
                waiting, total = [], 0
            waiting.append((found, seeds[langs[i]], owns[i]))
            total += len(found)
    if waiting:
        yield [w[0] for w in waiting], *(np.array([w[k] for w in waiting], np.uint64) for k in (1, 2)), pivots


def _laid_out(found: Sequence[np.ndarray], seeds: np.ndarray, span: int) -> Grams:
    """The n-grams of texts with the number of their text, in order of texts. The last one of each text ends on ``PAST``."""
    edge, stop = np.full(span - 1, START, np.uint64), np.array([END, PAST], np.uint64)
    flat = np.concatenate([part for s in found for part in (edge, s, stop)])
    rows = np.array([len(s) + 2 for s in found])
    salt = np.repeat(seeds, rows + span - 1)
    flat = _step(salt, flat)
    flat[np.cumsum(rows + span - 1) - 1] = PAST
    symbols, places = np.unique(flat, return_inverse=True)
    of = np.empty_like(symbols)
    of[places] = salt
    last = np.arange(rows.sum()) + np.repeat(np.arange(1, len(rows) + 1) * (span - 1), rows)
    columns = [places[last - back] for back in (*range(1, span), 0)]
    return Grams(symbols, of, columns, [np.repeat(np.arange(len(rows)), rows)])


def _by_place(grams: Grams, at: np.ndarray) -> Iterator[tuple[int, Grams]]:
    """(shard, n-grams) of sorted n-grams and the shard of each."""
    if len(at) and (at[1:] < at[:-1]).any():
        order = np.argsort(at, kind="stable")
        at, grams = at[order], Grams(grams.symbols, grams.of, [c[order] for c in grams.columns], [m[order] for m in grams.more])
    for shard, start, end in _pieces(at):
        yield shard, grams.cut(start, end)


def _crowd(pivots: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_unpack(pivots)) if pivots else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _crowded(docs: DataFrame, symbols: Symbols, text: str, lang: str, shards: int, most: int) -> DataFrame:
    """(data): one row with the pivots that are dealt over several shards, and over how many each."""
    read = symbols[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, seeds, _, _ in _runs(batches, read, most):
            keys = _step(np.repeat(seeds, [len(s) for s in found]), np.concatenate(found))
            keys, n = np.unique(keys, return_counts=True)
            often = n * 4 * shards > n.sum()
            yield pa.RecordBatch.from_arrays([pa.array([0, *keys[often].view(np.int64)]), pa.array([n.sum(), *n[often]])], names=["symbol", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {s: n for b in batches for s, n in zip(*[c.to_pylist() for c in b.columns], strict=True)}
        total = rows.pop(0, 0)
        often = sorted((s for s in rows if rows[s] * shards > CROWDED * total), key=rows.__getitem__)[-MOST_CROWDED:]
        keys = np.array(often, np.int64).view(np.uint64)
        parts = np.array([min(shards, math.ceil(2 * rows[s] * shards / (CROWDED * total))) for s in often], np.uint64)
        order = np.argsort(keys)
        yield pa.RecordBatch.from_arrays([pa.array([_pack(keys[order], parts[order])], pa.binary())], names=["data"])

    looked = docs.filter(F.pmod(F.xxhash64(F.lit(3), F.col(f"`{text}`")), F.lit(LOOKED_AT)) == 0)
    counts = _texts(looked, text, lang, F.lit(0).cast("long")).mapInArrow(count, "symbol long, n long")
    return counts.groupBy("symbol").agg(F.sum("n").alias("n")).repartition(1).mapInArrow(choose, "data binary")


class Tree(NamedTuple):
    """n-grams by order: ``contexts[k]`` are sorted keys of the contexts of order k, each the place of the context without
    its first symbol and that symbol; ``grams[k]`` sorted keys of the n-grams, each the place of its context and its last
    symbol, with their counts. The contexts of order 2 are the places of pivots among the symbols."""

    contexts: dict[int, np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]

    def rest(self, k: int) -> np.ndarray:
        """The keys of the n-grams of order k without their first symbol."""
        keys = self.grams[k][0]
        return (self.contexts[k][keys >> HALF] >> HALF << HALF) | (keys & LOW)


def _joined(place: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (place.view(np.uint64) << HALF) | last.view(np.uint64)


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> HALF).view(np.int64), (keys & LOW).view(np.int64)


def _tree(grams: Grams) -> Tree:
    span = len(grams.columns)
    at, tree = grams.columns[0], Tree({}, {})
    for k in range(3, span + 1):
        keys = _joined(at, grams.columns[k - 2])
        new = _starts(keys)
        tree.contexts[k], at = keys[new], np.cumsum(new) - 1
    tree.grams[span] = _joined(at, grams.columns[-1]), grams.more[0].astype(np.int64)
    for k in range(span, 2, -1):
        tree.grams[k - 1] = np.unique(tree.rest(k), return_counts=True)
    return tree


def _sums(order: int, n: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """By language: order, numbers of n-grams counted once, twice, three and four times, of all, and the sum of counts."""
    seeds, of = np.unique(of, return_inverse=True)
    often = [np.bincount(of[n == k], minlength=len(seeds)) for k in (1, 2, 3, 4)]
    total = np.bincount(of, n, minlength=len(seeds)).astype(np.int64)
    return [seeds, np.full(len(seeds), order), *often, np.bincount(of, minlength=len(seeds)), total]


def _count(order: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """n-grams of a shard, summed, and their pairs for the shards of the pivots."""
    span = max(order, 2)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            grams = _summed((Grams.read(row[3], span) for row in rows))
            if order > 1:
                yield _batch([(shard, GRAMS, 0, grams.pack())])
            tree = _tree(grams)
            sums = [_sums(k, n, grams.of[_split(keys)[1]]) for k, (keys, n) in tree.grams.items() if k > 2]
            if sums:
                yield _batch([(shard, SUMS, 0, _pack(*map(np.concatenate, zip(*sums, strict=True))))])
            keys, n = tree.grams[2]
            pairs = Grams(grams.symbols, grams.of, list(_split(keys)), [n])
            yield from _batches((at, PAIRS, shard, piece.pack()) for at, piece in _by_place(pairs, _shards(pairs, shards, *_crowd(None))))

    return task


def _summed(parts: Iterator[Grams]) -> Grams:
    held, rows, least = [], 0, HELD_ROWS
    for part in parts:
        held.append(part)
        rows += len(part.more[0])
        if rows > least:
            held = [_merged(held)]
            rows = len(held[0].more[0])
            least = max(HELD_ROWS, 2 * rows)
    return _merged(held)


def _pair(order: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of a shard's pivots, summed, and for the shards of their last symbols how many pivots each of these has."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            pairs = _summed((Grams.read(row[3], 2) for row in rows))
            n = pairs.more[0].view(np.int64)
            if order > 1:
                yield _batch([(shard, PAIRS, 0, pairs.pack()), (shard, SUMS, 0, _pack(*_sums(2, n, pairs.of[pairs.columns[1]])))])
                places, n = np.unique(pairs.columns[1], return_counts=True)
            else:
                seen = (pairs.symbols != _step(pairs.of, np.uint64(START)))[pairs.columns[0]]
                places, inner = np.unique(pairs.columns[0][seen], return_inverse=True)
                n = np.bincount(inner, n[seen], minlength=len(places)).astype(np.int64)
            lasts = Grams(pairs.symbols, pairs.of, [places], [n])
            yield from _batches((at, ASKED, shard, piece.pack()) for at, piece in _by_place(lasts, _shards(lasts, shards, *_crowd(None))))

    return task


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of pivots of each symbol over all shards, for the shards that asked and for the symbol's own."""
    for shard, rows in _by_shard(batches):
        asked = [(row[2], Grams.read(row[3], 1)) for row in rows]
        symbols, first, places = np.unique(np.concatenate([a.symbols for _, a in asked]), return_index=True, return_inverse=True)
        of = np.concatenate([a.of for _, a in asked])[first]
        n = np.bincount(places, np.concatenate([a.more[0] for _, a in asked])).astype(np.int64)
        own = Grams(symbols, of, [np.arange(len(symbols))], [n])
        yield _batch([(shard, OWN, 0, own.pack()), (shard, SUMS, 0, _pack(*_sums(1, n, of)))])
        ends = np.cumsum([len(a.symbols) for _, a in asked])
        yield from _batches((source, ANSWERED, shard, _pack(n[part])) for (source, _), part in zip(asked, np.split(places, ends[:-1]), strict=True))


def _finish(order: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The answers for the last symbols of a shard's pairs, in their order. Pairs of crowded pivots go with the answers to all
    shards that hold n-grams of these pivots; the pairs of other pivots are found in the n-grams of their only shard."""

    def copies(shard: int, kind: int, grams: Grams, rows: np.ndarray, crowd: tuple[np.ndarray, np.ndarray]) -> Iterator[Row]:
        for place, start, end in _pieces(grams.columns[0][rows]):
            piece = grams.cut(rows[start], rows[end - 1] + 1).pack()
            for part in range(int(crowd[1][np.searchsorted(crowd[0], grams.symbols[place])])):
                yield (shard + part) % shards, kind, shard, piece

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            by_kind = {kind: [row[3] for row in some] for kind, some in groupby(rows, key=itemgetter(1))}
            crowd = _crowd(by_kind[PIVOTS][0]) if PIVOTS in by_kind and order > 2 else _crowd(None)
            for data in by_kind.get(OWN, []):
                own = Grams.read(data, 1)
                often = np.isin(own.symbols, crowd[0])[own.columns[0]]
                yield from _batches([(shard, OWN, 0, data), *(r for r in copies(shard, OWN, own, np.flatnonzero(often), crowd) if r[0] != shard)])
            for data in by_kind.get(PAIRS, []):
                pairs = Grams.read(data, 2)
                last = np.zeros(len(pairs.symbols), np.uint64)
                last[np.unique(pairs.columns[1])] = np.concatenate([_unpack(a)[0] for a in by_kind[ANSWERED]])
                often = np.isin(pairs.symbols, crowd[0])[pairs.columns[0]]
                yield _batch([(shard, ANSWERED, 0, _pack(last[np.unique(pairs.columns[1][~often])]))])
                pairs = pairs._replace(more=[*pairs.more, last[pairs.columns[1]]])
                yield from _batches(copies(shard, PAIRS, pairs, np.flatnonzero(often), crowd))

    return task


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the sums of all shards."""
    parts = [_unpack(data) for b in batches for data in b.column(0).to_pylist()]
    if not parts:
        return
    columns = list(map(np.concatenate, zip(*parts, strict=True)))
    order = np.lexsort(columns[1::-1])
    columns = [c[order] for c in columns]
    new = np.flatnonzero(_starts(*columns[:2]))
    yield pa.RecordBatch.from_arrays([pa.array([_pack(*[c[new] for c in columns[:2]], *[np.add.reduceat(c, new) for c in columns[2:]])], pa.binary())], names=["data"])


class Model(NamedTuple):
    """Stored tables of counts by shard, and of sums by language; the pivots that are dealt over several shards."""

    order: int
    shards: int
    grams: DataFrame
    pairs: DataFrame
    sums: DataFrame
    pivots: DataFrame

    def discard(self) -> None:
        discard(self.grams, self.pairs, self.sums, self.pivots)


def _everywhere(one: DataFrame, shards: int, kind: int) -> DataFrame:
    """The only row of a table, for each shard."""
    ids = one.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return ids.crossJoin(F.broadcast(one)).select("shard", F.lit(kind).alias("kind"), F.lit(0).alias("source"), "data")


def model(docs: DataFrame, order: int = ORDER, text: str = "text", lang: str = "lang", symbols: Symbols = CHARACTERS, most: int = SHARD_ROWS) -> Model:
    """The counts of a model: n-grams with the numbers of their occurrences, and pairs of a pivot and a symbol with the
    number of different symbols before them and that of the different pivots of the symbol. Lower orders count different
    left neighbours. Rows of a shard are all that its shares and weights are made from, but for the sums by language."""
    spark, span, read = docs.sparkSession, max(order, 2), symbols[0]
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, seeds, _, pivots in _runs(batches, read, most):
            grams = _laid_out(found, seeds, span)
            some = grams.symbols[grams.columns[-1]] != PAST if order > 1 else slice(None)
            grams = _merged([Grams(grams.symbols, grams.of, [c[some] for c in grams.columns], [np.ones_like(grams.more[0][some])])])
            yield from _batches((shard, GRAMS, 0, piece.pack()) for shard, piece in _by_place(grams, _shards(grams, shards, *_crowd(pivots))))

    with shuffles_dropped(spark), narrow_batches(spark):
        pivots = stored(_crowded(docs, symbols, text, lang, shards, most), "kn-pivots")
        rows = _texts(docs, text, lang, F.lit(0).cast("long"), pivots).mapInArrow(gives_back(lay_out), ROWS)
        grams = stored(_dealt(rows, shards, _count(order, shards)), "kn-grams", ["kind"])
        pairs = stored(_dealt(grams.filter(F.col("kind") == PAIRS), shards, _pair(order, shards)), "kn-pairs", ["kind"])
        discard_part(grams, f"kind={PAIRS}")
        answers = stored(_dealt(pairs.filter(F.col("kind") == ASKED), shards, _answer), "kn-answers", ["kind"])
        discard_part(pairs, f"kind={ASKED}")
        sums = reduce(DataFrame.unionAll, [t.filter(F.col("kind") == SUMS).select("data") for t in (grams, pairs, answers)])
        sums = stored(sums.repartition(1).mapInArrow(_add_up, "data binary"), "kn-sums")
        ready = [pairs.filter(F.col("kind") == PAIRS), answers.filter(F.col("kind").isin(ANSWERED, OWN)), _everywhere(pivots, shards, PIVOTS)]
        ready = [df.select("shard", "kind", "source", "data") for df in ready]
        done = stored(_dealt(reduce(DataFrame.unionAll, ready), shards, _finish(order, shards)), "kn-model")
        discard(pairs, answers)
    return Model(order, shards, grams, done, sums, pivots)


class Values:
    """What each n-gram and context of a shard adds to the logarithm of a text's probability."""

    def __init__(self, order: int, sums: bytes | None, grams: Grams | None, lasts: bytes | None, pairs: Sequence[Grams], own: Sequence[Grams]):
        """``lasts`` are the numbers of pivots of the last symbols; ``pairs`` those of pivots that other shards have too."""
        self.order, parts = order, [*([grams] if grams else []), *pairs, *own]
        self.symbols, first = np.unique(np.concatenate([np.zeros(0, np.uint64), *[p.symbols for p in parts]]), return_index=True)
        of = np.concatenate([np.zeros(0, np.uint64), *[p.of for p in parts]])[first]
        self._learn(_unpack(sums) if sums else [np.zeros(0, np.uint64)] * 8)
        lang = np.searchsorted(self.seeds, of)
        at = lambda p: np.searchsorted(self.symbols, p.symbols)
        self.alone = np.zeros(len(self.symbols) + 1)
        for p in own:
            places, n = at(p)[p.columns[0]], p.more[0].astype(float)
            self.alone[places] = np.log1p(self._share(n, lang[places]) / self.weight[lang[places]])
        self.contexts, self.weights, self.grams, self.gains = {}, {}, {}, {}
        if order < 2:
            return
        none = np.zeros(0, np.int64)
        keys, n, kinds, tree = none.view(np.uint64), none, none, None
        if grams:
            tree = _tree(grams._replace(symbols=self.symbols, of=of, columns=[at(grams)[c] for c in grams.columns]))
            keys, n = tree.grams[2]
            alone = ~np.isin(_split(keys)[0], np.concatenate([none, *[at(p)[p.columns[0]] for p in pairs]]))
            keys, n = keys[alone], n[alone]
            last = _split(keys)[1]
            number = np.zeros(len(self.symbols), np.int64)
            number[np.unique(last)] = _unpack(lasts)[0].view(np.int64) if lasts else 0
            kinds = number[last]
        keys = np.concatenate([keys, *[_joined(*(at(p)[c] for c in p.columns)) for p in pairs]])
        n, kinds = (np.concatenate([rest, *[p.more[i].view(np.int64) for p in pairs]]) for i, rest in enumerate((n, kinds)))
        by = np.argsort(keys)
        keys, n, kinds = keys[by], n[by], kinds[by]
        pivot, last = _split(keys)
        p = self._share(kinds, lang[last]) + self.weight[lang[last]]
        p = self._level(2, keys, pivot, n, lang[last], len(self.symbols), p)
        for k in range(3, order + 1) if tree else ():
            lower = p[np.searchsorted(self.grams[k - 1], tree.rest(k))]
            keys, n = tree.grams[k]
            context, last = _split(keys)
            self.contexts[k] = tree.contexts[k]
            p = self._level(k, keys, context, n, lang[last], len(tree.contexts[k]), lower)

    def _learn(self, sums: list[np.ndarray]) -> None:
        """Discounts by order and language, and the weight of unseen symbols."""
        seeds, orders, n1, n2, n3, n4, kinds, total = sums
        self.seeds = np.unique(seeds)
        at, n1, n2, n3, n4 = np.searchsorted(self.seeds, seeds), *(n.astype(float) for n in (n1, n2, n3, n4))
        self.cuts = np.full((self.order + 1, len(self.seeds), 3), 0.5)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = n1 / (n1 + 2 * n2)
            for k, (less, more) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
                cut = np.clip(k - (k + 1) * y * more / less, 0.1, k)
                self.cuts[orders.astype(np.int64), at, k - 1] = np.where((less > 0) & (n1 > 0), cut, 0.5)
        one = orders == 1
        self.all, self.weight = np.ones(len(self.seeds)), np.full(len(self.seeds), NO_MODEL)
        cuts = self.cuts[1, at[one]]
        free = n1[one] * cuts[:, 0] + n2[one] * cuts[:, 1] + (kinds[one] - n1[one] - n2[one]) * cuts[:, 2]
        self.all[at[one]] = total[one]
        self.weight[at[one]] = free / total[one] / (kinds[one] + 1.0)

    def _cut(self, k: int, n: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return self.cuts[k, lang, np.minimum(n, 3).astype(np.int64) - 1]

    def _share(self, n: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return (n - self._cut(1, n, lang)) / self.all[lang]

    def _level(self, k: int, keys: np.ndarray, context: np.ndarray, n: np.ndarray, lang: np.ndarray, size: int, lower: np.ndarray) -> np.ndarray:
        """Keep the weights of the contexts and what n-grams add to them; the probabilities of the n-grams."""
        cut = self._cut(k, n, lang)
        total, free = np.bincount(context, n, size), np.bincount(context, cut, size)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = free / total
            self.weights[k] = np.append(np.where(total > 0, np.log(weight), 0.0), 0.0)
        share, rest = (n - cut) / total[context], weight[context] * lower
        self.grams[k], self.gains[k] = keys, np.append(np.log1p(share / rest), 0.0)
        return share + rest

    def base(self, seeds: np.ndarray) -> np.ndarray:
        """The logarithm of an unseen symbol's share in each language."""
        out = np.full(len(seeds), np.log(NO_MODEL))
        at = _find(self.seeds, seeds)
        out[at < len(self.seeds)] = np.log(self.weight[at[at < len(self.seeds)]])
        return out

    def of(self, wanted: Grams) -> np.ndarray:
        """What each n-gram adds, but for the share of unseen symbols."""
        places = _find(self.symbols, wanted.symbols)
        columns = [places[c] for c in wanted.columns]
        at, last = columns[0], columns[-1]
        out = self.alone[at]
        rows = np.arange(len(at))
        for k in range(2, self.order + 1):
            if k not in self.grams:
                break
            if k > 2:
                at = _find(self.contexts[k], _joined(at, columns[k - 2][rows]))
            there = at < len(self.weights[k]) - 1
            at, rows = at[there], rows[there]
            found = _find(self.grams[k], _joined(at, last[rows]))
            out[rows] += self.weights[k][at] + self.gains[k][found]
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key among sorted ones; their number for one that is not there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


def _score(order: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document with n-grams in a shard what these add, how many symbols they predict, and how many of its copies
    end there. These sums lie in buckets of documents."""
    span = max(order, 2)

    def sums(values: Values, pieces: Sequence[Grams]) -> tuple[np.ndarray, ...]:
        wanted, owns, seeds = _beside(pieces)
        who = wanted.more[0]
        real = wanted.symbols[wanted.columns[-1]] != PAST
        n = np.bincount(who[real], minlength=len(owns))
        return owns, np.bincount(who, values.of(wanted), len(owns)) + n * values.base(seeds), n, np.bincount(who[~real], minlength=len(owns))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            held, pieces, size, found, values = {kind: [] for kind in (GRAMS, PAIRS, ANSWERED, OWN, SUMS)}, [], 0, [], None
            for _, kind, _, data in rows:
                if kind != WANTED:
                    held[kind].append(data if kind in (SUMS, ANSWERED) else Grams.read(data, {GRAMS: span, PAIRS: 2, OWN: 1}[kind]))
                    continue
                if values is None:
                    values = Values(order, *[next(iter(held.pop(kind)), None) for kind in (SUMS, GRAMS, ANSWERED)], held.pop(PAIRS), held.pop(OWN))
                pieces.append(Grams.read(data, span))
                size += len(pieces[-1].more[0])
                if size > LOOKED_UP:
                    found.append(sums(values, pieces))
                    pieces, size = [], 0
            if pieces:
                found.append(sums(values, pieces))
            if found:
                owns, log, n, copies = _added(map(np.concatenate, zip(*found, strict=True)))
                some = lambda s, e: _pack(np.diff(owns[s:e], prepend=np.uint64(0)), log[s:e].view(np.uint64), n[s:e], copies[s:e])
                yield from _batches((bucket, WANTED, shard, some(s, e)) for bucket, s, e in _pieces(_place(owns, buckets)))

    return task


def _beside(pieces: Sequence[Grams]) -> tuple[Grams, np.ndarray, np.ndarray]:
    """The n-grams of all pieces, with symbols and documents one after another, and the documents and their languages."""
    before = lambda sizes: np.cumsum([0, *sizes[:-1]])
    symbols, docs = before([len(p.symbols) for p in pieces]), before([len(p.more[1]) for p in pieces])
    columns = [np.concatenate([p.columns[i] + start for p, start in zip(pieces, symbols, strict=True)]) for i in range(len(pieces[0].columns))]
    who = np.concatenate([p.more[0].view(np.int64) + start for p, start in zip(pieces, docs, strict=True)])
    all_of = lambda get: np.concatenate([get(p) for p in pieces])
    return Grams(all_of(lambda p: p.symbols), all_of(lambda p: p.of), columns, [who]), all_of(lambda p: p.more[1]), all_of(lambda p: p.more[2])


def _added(sums: Iterable[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sums of different documents, sorted by these."""
    owns, log, n, copies = sums
    owns, at = np.unique(owns, return_inverse=True)
    return owns, np.bincount(at, log, len(owns)), *(np.bincount(at, c, len(owns)).astype(np.int64) for c in (n, copies))


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own, log, n, copies) of the documents of a bucket."""
    for _, rows in _by_shard(batches):
        parts = [_unpack(row[3]) for row in rows]
        owns, log, n, copies = map(np.concatenate, zip(*parts, strict=True))
        edges = np.cumsum([0, *[len(p[0]) for p in parts]])
        owns = np.concatenate([np.cumsum(owns[s:e], dtype=np.uint64) for s, e in zip(edges, edges[1:], strict=False)])
        owns, log, n, copies = _added((owns, log.view(np.float64), n.view(np.int64), copies.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(owns.view(np.int64)), pa.array(log), pa.array(n), pa.array(copies)], names=["own", "log", "n", "copies"])


def _key(text: str, lang: str) -> Column:
    return F.xxhash64(F.lit(2), F.col(f"`{lang}`").isNull(), F.col(f"`{lang}`"), F.col(f"`{text}`"))


def _means(docs: DataFrame, table: Model, text: str, lang: str, most: int, symbols: Symbols, rounds: int) -> list[DataFrame]:
    """Stored tables (own, log, n, copies) of different documents: the logarithm of the probability of all copies of each, the
    symbols that it is of, an end for each copy among them, and how many copies there are."""
    spark, read, span, shards = docs.sparkSession, symbols[0], max(table.order, 2), table.shards
    own, tasks = _key(text, lang), max(spark.sparkContext.defaultParallelism, shards // rounds)

    def ask(piece: Grams, owns: np.ndarray, seeds: np.ndarray) -> bytes:
        there = np.zeros(len(owns), bool)
        there[piece.more[0]] = True
        return piece._replace(more=[(np.cumsum(there) - 1)[piece.more[0]]]).pack(owns[there], seeds[there])

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, seeds, owns, pivots in _runs(batches, read, most):
            grams = _arranged(_laid_out(found, seeds, span))
            grams = grams._replace(of=np.zeros_like(grams.of))
            yield from _batches((shard, WANTED, 0, ask(piece, owns, seeds)) for shard, piece in _by_place(grams, _shards(grams, shards, *_crowd(pivots))))

    known = [table.grams.filter(F.col("kind") == GRAMS), table.pairs, _everywhere(table.sums, shards, SUMS)]
    known = reduce(DataFrame.unionAll, [df.select("shard", "kind", "source", "data") for df in known])
    out = []
    with shuffles_dropped(spark), narrow_batches(spark):
        for turn in range(rounds):
            some = _texts(docs.filter(F.pmod(own, F.lit(rounds)) == turn).coalesce(tasks), text, lang, own, table.pivots)
            sums = _dealt(known.unionAll(some.mapInArrow(gives_back(lay_out), ROWS)), shards, _score(table.order, tasks))
            out.append(stored(_dealt(sums, tasks, _total, "own long, log double, n long, copies long"), "kn-scores"))
    return out


def _with_means(rows: DataFrame, parts: Sequence[DataFrame], text: str, lang: str) -> DataFrame:
    """``rows`` with ``perplexity`` and ``n_symbols``."""
    each = (F.col("n") / F.col("copies")).cast("long") - 1
    total = reduce(DataFrame.unionAll, parts).select("own", F.exp(-F.col("log") / F.col("n")).alias("perplexity"), each.alias("n_symbols"))
    rows = rows.withColumn("own", _key(text, lang)).join(total, "own", "left").drop("own")
    return rows.withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0).cast("long")))


def scored(
    docs: DataFrame, table: Model, order: int = ORDER, text: str = "text", lang: str = "lang", shard_rows: int = SHARD_ROWS,
    symbols: Symbols = CHARACTERS, rounds: int = ROUNDS,
) -> DataFrame:
    """``docs`` with ``perplexity`` per symbol of the whole text and ``n_symbols``; both columns replace ones of these
    names. Texts without symbols have null perplexity. ``table`` is a ``model`` of the same order and symbols.

    Rows with the same language and text are one document: their sums and their numbers of symbols grow alike.
    """
    if order != table.order:
        raise ValueError(f"the model is of order {table.order}")
    others = [c for c in docs.columns if c not in ("perplexity", "n_symbols")]
    rows = docs.select(packed(others).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    parts = _means(rows, table, "text", "lang", shard_rows, symbols, rounds)
    return unpacked(_with_means(rows, parts, "text", "lang"), "row", ["perplexity", "n_symbols"])


def _left_out(few: DataFrame, order: int, quantile: float, shard_rows: int, symbols: Symbols) -> DataFrame:
    """(of, threshold) of languages from few texts (lang, text): each text is scored by a model of the others."""
    name = F.concat_ws("=", F.coalesce("lang", F.lit("?")), F.col("lang").isNull().cast("string"), F.sha2("text", 256))
    out = few.select(F.col("lang").alias("of"), name.alias("lang"), F.col("text").alias("out"))
    pairs = stored(out.join(few.withColumnRenamed("lang", "other"), F.col("of").eqNullSafe(F.col("other")) & (F.col("out") != F.col("text"))), "kn-left-out")
    alone = scored(
        pairs.select("of", "lang", F.col("out").alias("text")).distinct(), model(pairs.select("lang", "text"), order, symbols=symbols, most=shard_rows),
        order, shard_rows=shard_rows, symbols=symbols, rounds=1,
    )
    return alone.groupBy("of").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))


def judged(
    docs: DataFrame, trusted: Column, keep: Sequence[str] | None = None, order: int = ORDER, quantile: float = QUANTILE,
    text: str = "text", lang: str = "lang", shard_rows: int = SHARD_ROWS, symbols: Symbols = WORDS, source: str | None = None,
    rounds: int = ROUNDS, texts: DataFrame | None = None,
) -> DataFrame:
    """The columns ``keep`` (all, unless named) with ``perplexity``, ``n_symbols``, the ``threshold`` of the language and
    ``kept``, which replace columns of these names. ``source`` names one more column that tells the threshold's origin.
    ``texts`` are the same rows with text and language, if reading them for each round takes less than reading ``docs``.

    ``trusted`` marks the rows the model is trained on, but for a share of texts, by their hash, that it never sees. A
    language's threshold is the given quantile of the perplexities of that share (source ``unseen``). If all or none of a
    language's trusted texts fall into the share, the model is trained on all of them, and the threshold comes from each
    of them scored by a model of the others (``left_out``). A language with one trusted text or none has nothing to be
    judged by: its threshold is null (``none``) and its rows are kept. Texts without symbols are not kept. A null language
    is a language of its own.
    """
    marked = docs.select(
        packed(keep or docs.columns).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"),
        F.coalesce(trusted, F.lit(False)).alias("trusted"),
    )
    unseen = F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(MEASURED)) == 0
    good = marked.filter(F.col("trusted") & (symbols[1]("text") > 0)).select("lang", "text", unseen.alias("unseen"))
    few = good.groupBy(F.col("lang").alias("few")).agg(F.min("unseen").alias("low"), F.max("unseen").alias("high"))
    few = stored(few.filter("low = high").select("few", F.lit(True).alias("whole")), "kn-few")
    marked = marked.join(few, F.col("lang").eqNullSafe(F.col("few")), "left")
    marked = marked.withColumn("measured", F.col("trusted") & unseen & F.col("whole").isNull()).drop("few", "whole")
    table = model(marked.filter("trusted AND NOT measured"), order, symbols=symbols, most=shard_rows)
    parts = _means(marked if texts is None else texts.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")), table, "text", "lang", shard_rows, symbols, rounds)
    table.discard()
    with shuffles_dropped(docs.sparkSession):
        rows = stored(_with_means(marked.select("row", "lang", "measured", "text"), parts, "text", "lang").drop("text"), "kn-scored")
    discard(*parts)
    limits = rows.filter("measured").groupBy(F.col("lang").alias("of")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    limits = limits.filter("threshold IS NOT NULL").withColumn("source", F.lit("unseen"))
    if not few.isEmpty():
        texts = stored(good.join(few, F.col("lang").eqNullSafe(F.col("few"))).select("lang", "text").distinct(), "kn-few")
        limits = limits.unionAll(_left_out(texts, order, quantile, shard_rows, symbols).withColumn("source", F.lit("left_out")))
    out = rows.join(stored(limits, "kn-limits"), F.col("lang").eqNullSafe(F.col("of")), "left")
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    out, added = out.withColumn("kept", kept), ["perplexity", "n_symbols", "threshold", "kept"]
    if source:
        out, added = out.withColumn(source, F.coalesce("source", F.lit("none"))), [*added, source]
    return unpacked(out, "row", added)
