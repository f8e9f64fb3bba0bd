"""Exact Jaccard join of word shingle sets: regions around pivots, triangle inequality, recursion.

Jaccard distance (1 - similarity) is a metric, but documents that share no shingle are all at distance 1 from each other.
Regions around a few pivots would therefore hold copies of nearly all documents. So the first partition is by shared
shingles: shingles are ordered from rare to common, and two sets whose similarity reaches the threshold share one of
the first n - ceil(threshold * n) + 1 of each. The sets that hold a shingle there are a region, and a set lies in as
many regions as it may have partners in. Regions inside a larger one are left out.

Within regions the join is metric. Every set of a region is compared with its pivot, the smallest set id, which gives its
distance. What is linked to the pivot is one class and needs no links among itself. Regions that still hold several
classes are joined once more: sets of different classes are compared if their sizes and their distances to the pivot
differ by no more than linked sets can (the triangle inequality), large regions block by block. Two sets that meet in
several large regions are left to the first of them. Parity sketches, whose Hamming distance never exceeds the size of
the symmetric difference, spare the exact comparison of most other pairs.

Equal sets are one set throughout, and set ids stand for documents until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from palmares.llm.common import gives_back, let_go, packed, slices, unpacked
from palmares.llm.components import smallest_reachable
from palmares.store import discard, stored

WORDS = 5
#: Sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles in so many sets or more count as common; their classes of frequency are kept for hashes modulo BINS.
COMMON, BINS = 24, 1 << 20
#: A screen of ids that a scan tests before anything is shuffled has so many bits an id, up to a bound. Beyond the bound
#: more ids pass that a join has to sort out, which costs shuffled bytes and changes no result.
SCREEN_BITS, LARGEST_SCREEN = 32, 1 << 27
#: Sets of a region that are paired by a join; larger regions go block by block.
FEW, BLOCK = 64, 1024
#: Large regions of a set, the first in order, that later ones know of; pairs that meet in none of these may come twice.
EARLIER = 16
_DRAW = np.random.default_rng(20240229)
_BYTE = _DRAW.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = [np.uint64(int(x) | 1) for x in _DRAW.integers(1, 1 << 63, 64)]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text with A-Z lower-cased; words end at ASCII white space."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    inside = ~gap
    length = ends - starts
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    powers = np.cumprod(np.full(int(length.max()), _BASE)) if len(length) else np.zeros(0, np.uint64)
    sums = np.add.reduceat(_BYTE[data[inside]] * powers[place], np.cumsum(length) - length)
    return _mixed(sums ^ length.astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles of a text; all its words as one if they are fewer; none without words."""
    hashes = word_hashes(text or "")
    size = min(words, len(hashes))
    if not size:
        return np.zeros(0, np.uint64)
    total = np.full(len(hashes) - size + 1, np.uint64(size))
    for i in range(size):
        total = total + hashes[i:len(hashes) - size + 1 + i] * _STEPS[i % len(_STEPS)]
    return np.unique(_mixed(total))


def set_id(tokens: np.ndarray) -> int:
    """A 63-bit id of a set of shingles, the same for equal sets."""
    places = _mixed(tokens + np.arange(len(tokens), dtype=np.uint64) * _BASE)
    return int(_mixed(np.array([np.bitwise_xor.reduce(places) + np.uint64(len(tokens))], np.uint64))[0] >> np.uint64(1))


def prefix(tokens: np.ndarray, classes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The rarest shingles of a set, one of which any partner shares."""
    n = len(tokens)
    first = n - -(-n * percent // 100) + 1
    order = np.lexsort([tokens, classes[(tokens % np.uint64(len(classes))).astype(np.int64)]])
    return tokens[order[:first]]


def sketch(tokens: np.ndarray) -> bytes:
    """For each hash modulo a power of two, about twice the size of the set, the parity of the shingles that have it."""
    bits = 1 << max(6, (2 * len(tokens)).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Sketches of the same sets for a smaller power of two."""
    while rows.shape[-1] > width:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] ^ rows[..., half:]
    return rows


def may_link(a: bytes, b: bytes, sizes: int, percent: int) -> bool:
    """False only if the symmetric difference is too large for a link of sets with so many shingles together."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    apart = int(np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum())
    return apart * (100 + percent) <= sizes * (100 - percent)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bounded set of bits that holds every id of ``column``; other ids may pass, and are sorted out by a join."""
    bits = min(LARGEST_SCREEN, 1 << max(16, (SCREEN_BITS * ids.count() - 1).bit_length()))
    places = ids.select(F.pmod(F.col(column), F.lit(bits)).cast("int").alias("bit")).distinct()
    words = places.groupBy(F.floor(F.col("bit") / 32).alias("word")).agg(F.expr("bit_or(shiftleft(1L, bit % 32))").alias("bits"))
    table = words.toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    return out


def _passes(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = np.mod(ids.astype(np.int64), len(bitmap) * 32)
    return (bitmap[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1) == 1


def several(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that two of the sets or more hold, and how many do. Empties the list: the shingles are held twice at most."""
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    sets.clear()
    flat.sort()
    tokens, n = np.unique(flat[1:][flat[1:] == flat[:-1]], return_counts=True)
    return tokens, n + 1


def common_classes(rows: DataFrame, words: int) -> np.ndarray:
    """For hashes modulo ``BINS`` the logarithm of how many sets hold a common shingle; 0 for rare ones.

    Tasks report the shingles that several of their different sets hold. The classes only order shingles, so what a task
    cannot see costs time and never a link. The table is bounded by ``BINS``.
    """

    @gives_back
    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            sets = {}
            for _, texts in slices(batch, batch.column(0)):
                for text in texts:
                    tokens = shingles(text, words)
                    sets[set_id(tokens)] = tokens
            held = list(sets.values())
            sets.clear()
            tokens, n = several(held)
            yield pa.RecordBatch.from_arrays([_signed(tokens), pa.array(n, pa.int64())], names=["token", "n"])

    counted = rows.select("text").mapInArrow(repeated, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    token = F.col("token")
    # Unsigned remainder of the signed token; BINS divides 2^64.
    bins = counted.groupBy(F.pmod(token, F.lit(BINS)).alias("bin")).agg(F.floor(F.log2(F.max("n"))).cast("int").alias("class")).toArrow()
    out = np.zeros(BINS, np.uint8)
    out[bins.column("bin").to_numpy()] = bins.column("class").to_numpy()
    return out


def _common_before(lists: pa.ListArray, token: int) -> np.ndarray:
    """Bits of every list for the numbers below ``token`` that several lists hold."""
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    low = flat < token
    values, place, n = np.unique(flat[low], return_inverse=True, return_counts=True)
    held = np.zeros((len(lists), len(values)), bool)
    held[row[low], place] = True
    return np.packbits(held[:, n > 1], axis=1)


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


class Join:
    """One run over the rows (key, text): sets, regions, compared pairs, links."""

    def __init__(self, rows: DataFrame, words: int, percent: int):
        self.rows, self.words, self.percent = rows, words, percent
        spark = rows.sparkSession
        classes = spark.sparkContext.broadcast(common_classes(rows, words))

        @gives_back
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            let_go()
            order = classes.value
            for batch in batches:
                for part, texts in slices(batch, batch.column(1)):
                    sets = [shingles(t, words) for t in texts]
                    first = [prefix(s, order, percent) if len(s) else s for s in sets]
                    yield pa.RecordBatch.from_arrays([
                        part.column(0), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([f.tobytes() for f in first], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary()),
                    ], names=["key", "set", "n", "prefix", "sketch"])

        kind = f"key {rows.schema['key'].dataType.simpleString()}, set long, n long, prefix binary, sketch binary"
        wide = stored(rows.select("key", "text").mapInArrow(read, kind), "jaccard-wide")
        self.sets = stored(wide.select("key", "set", "n"), "jaccard-sets")
        self.regions = self._regions(wide)
        held = self.regions.select("set").distinct()
        sketches = wide.select("set", "n", "sketch").join(held, "set", "left_semi").groupBy("set").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        self.sketches = stored(sketches, "jaccard-sketches")
        discard(wide)

    def _regions(self, wide: DataFrame) -> DataFrame:
        """(token, set, n): the sets that hold a shingle among their rarest, for shingles of two sets or more.

        Edited copies share most of their rarest shingles, so most regions lie inside a larger one of the same sets. That
        one returns all pairs of both, and the inner region is left out.
        """

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
                flat = np.frombuffer(b"".join(batch.column(1).take(pa.array(first)).to_pylist()), np.uint64)
                yield pa.RecordBatch.from_arrays([_signed(flat)], names=["token"])

        seen = wide.select("set", "prefix").mapInArrow(tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        again = stored(seen.filter("n > 1").select("token"), "jaccard-tokens")
        screen = self.rows.sparkSession.sparkContext.broadcast(_bitmap(again, "token"))
        discard(again)

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, sizes, firsts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
                lengths = np.array([len(f) // 8 for f in firsts])
                flat = np.frombuffer(b"".join(firsts), np.int64)
                kept = _passes(screen.value, flat)
                columns = [pa.array(flat[kept]), pa.array(np.repeat(ids, lengths)[kept]), pa.array(np.repeat(sizes, lengths)[kept])]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "set", "n"])

        rows = wide.select("set", "n", "prefix").mapInArrow(entries, "token long, set long, n long").distinct()
        rows = stored(rows, "jaccard-entries")
        several = stored(rows.groupBy("token").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "jaccard-several")
        # A region whose sets all have one and the same other region as their largest lies inside that one.
        largest = F.max(F.struct("many", "token")).over(Window.partitionBy("set"))["token"]
        placed = stored(rows.join(several, "token").select("token", "set", "n", largest.alias("largest")), "jaccard-placed")
        discard(rows, several)
        span = placed.groupBy("token").agg(F.min("largest").alias("low"), F.max("largest").alias("high"))
        outer = stored(span.filter("low <> high OR low = token").select("token"), "jaccard-outer")
        regions = stored(placed.drop("largest").join(outer, "token", "left_semi"), "jaccard-regions")
        discard(placed, outer)
        return regions

    def _held(self, pairs: DataFrame) -> DataFrame:
        """(set, tokens) of the sets of some pairs, read again from the texts."""
        wanted = stored(pairs.select(F.col("a").alias("set")).unionAll(pairs.select("b")).distinct(), "jaccard-wanted")
        screen, words = self.rows.sparkSession.sparkContext.broadcast(_bitmap(wanted, "set")), self.words

        @gives_back
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            let_go()
            for batch in batches:
                sets, before = {}, set()
                for _, texts in slices(batch, batch.column(0)):
                    for text in texts:
                        tokens = shingles(text, words)
                        name = set_id(tokens)
                        if name not in before and _passes(screen.value, np.array([name]))[0]:
                            before.add(name)
                            sets[name] = tokens.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.binary())], names=["set", "tokens"])
                    sets.clear()

        found = self.rows.select("text").mapInArrow(read, "set long, tokens binary")
        members = stored(found.join(wanted, "set", "left_semi").groupBy("set").agg(F.first("tokens").alias("tokens")), "jaccard-members")
        discard(wanted)
        return members

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that their sketches do not rule out."""
        percent = self.percent

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [may_link(x, y, n, percent) for x, y, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
                yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

        side = lambda name: self.sketches.select(F.col("set").alias(name), F.col("sketch").alias(f"sketch_{name}"), F.col("n").alias(f"n_{name}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b", (F.col("n_a") + F.col("n_b")).alias("sizes"))
        return stored(both.mapInArrow(keep, "a long, b long"), "jaccard-near")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """(a, b, far, linked) of pairs (a, b): the exact distance of the two sets."""
        percent = self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far, linked = [], []
                for x, y in zip(batch.column(2), batch.column(3)):
                    a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    union = len(a) + len(b) - both
                    far.append(1 - both / union)
                    linked.append(100 * both >= percent * union)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.float64()), pa.array(linked)], names=["a", "b", "far", "linked"])

        members = self._held(pairs)
        left = members.select(F.col("set").alias("a"), F.col("tokens").alias("left"))
        right = members.select(F.col("set").alias("b"), F.col("tokens").alias("right"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        found = stored(both.mapInArrow(compare, "a long, b long, far double, linked boolean"), "jaccard-compared")
        discard(members)
        return found

    def links(self) -> DataFrame:
        """(a, b): linked pairs of different sets, enough of them to connect every class."""
        pivots = self.regions.groupBy("token").agg(F.min(F.struct("set", "n")).alias("first"))
        pivots = stored(pivots.select("token", F.col("first.set").alias("pivot"), F.col("first.n").alias("pivot_n")), "jaccard-pivots")
        placed = self.regions.join(pivots, "token")
        stars = placed.filter((F.col("set") != F.col("pivot")) & _sizes_fit(F.col("n"), F.col("pivot_n"), self.percent))
        stars = stored(stars.select(F.col("pivot").alias("a"), F.col("set").alias("b")).distinct(), "jaccard-stars")
        near = self.near(stars)
        found = self.compared(near)
        links = found.filter("linked").select("a", "b")
        roots = stored(smallest_reachable(links).withColumnRenamed("node", "set"), "jaccard-roots")
        # Sets that were not compared with the pivot have no distance to it and stay comparable to all.
        far = found.select(F.col("a").alias("pivot"), F.col("b").alias("set"), "far")
        named = placed.join(roots, "set", "left").join(far, ["pivot", "set"], "left").select(
            "token", "set", "n", F.when(F.col("set") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("far")).alias("far"), F.coalesce("root", "set").alias("class")
        )
        named = stored(named, "jaccard-named")
        discard(near, pivots, roots, self.regions)
        state = named.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("class").alias("low"), F.max("class").alias("high"))
        state = stored(state.filter("low <> high").select("token", "many"), "jaccard-state")
        left = named.join(state, "token")
        pairs = stored(self._few(left.filter(F.col("many") <= FEW)).unionAll(self._many(left.filter(F.col("many") > FEW))).distinct(), "jaccard-pairs")
        near = self.near(pairs.join(stars, ["a", "b"], "left_anti"))
        discard(named, state, pairs, stars, self.sketches)
        more = self.compared(near)
        every = stored(links.unionAll(more.filter("linked").select("a", "b")), "jaccard-links")
        discard(near, found, more)
        return every

    def _few(self, left: DataFrame) -> DataFrame:
        """Pairs of different classes that may link, in regions of at most ``FEW`` sets."""
        reach = 1 - self.percent / 100 + 1e-9
        other = left.select("token", *[F.col(c).alias(f"{c}_y") for c in ("set", "n", "far", "class")])
        ring = F.coalesce(F.abs(F.col("far") - F.col("far_y")) <= reach, F.lit(True))
        met = left.join(other, "token").filter((F.col("set") < F.col("set_y")) & (F.col("class") != F.col("class_y")))
        return met.filter(ring & _sizes_fit(F.col("n"), F.col("n_y"), self.percent)).select(F.col("set").alias("a"), F.col("set_y").alias("b"))

    def _many(self, left: DataFrame) -> DataFrame:
        """The same in larger regions: every two blocks of a region are one task's group, which returns what its
        sketches do not rule out and no earlier region of both sets returns."""
        percent, reach = self.percent, 1 - self.percent / 100 + 1e-9
        blocks = F.ceil(F.col("many") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("set"), blocks).cast("int")
        earlier = left.groupBy("set").agg(F.slice(F.array_sort(F.collect_set("token")), 1, EARLIER).alias("earlier"))
        dealt = left.join(self.sketches.select("set", "sketch").join(earlier, "set"), "set").withColumn("own", own)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

        def join_blocks(table: pa.Table) -> pa.Table:
            ids, sizes, groups, own, i, j = (table.column(c).to_numpy() for c in ("set", "n", "class", "own", "i", "j"))
            far = table.column("far").to_numpy(zero_copy_only=False)
            sketches = table.column("sketch").to_pylist()
            width = np.array([len(s) for s in sketches])
            before = _common_before(table.column("earlier").combine_chunks(), table.column("token")[0].as_py())
            out = []
            for w in np.unique(width):
                left_at = np.flatnonzero(width == w)
                right_at = np.flatnonzero((width == w) | (width == 2 * w))
                a = np.stack([np.frombuffer(sketches[k], np.uint64) for k in left_at])
                b = np.stack([_folded(np.frombuffer(sketches[k], np.uint64), w // 8) for k in right_at])
                for start in range(0, len(a), 32):
                    at = left_at[start:start + 32]
                    size = sizes[at][:, None] + sizes[right_at]
                    ring = ~(np.abs(far[at][:, None] - far[right_at]) > reach)
                    # Of a block with itself, and of sketches of one width, each pair once.
                    once = (ids[at][:, None] < ids[right_at]) | (width[right_at] > w)
                    across = (own[at][:, None] != own[right_at]) | (i[0] == j[0])
                    fit = np.minimum(sizes[at][:, None], sizes[right_at]) * 100 >= np.maximum(sizes[at][:, None], sizes[right_at]) * percent
                    x, y = np.nonzero(ring & once & across & fit & (groups[at][:, None] != groups[right_at]))
                    for k in range(0, len(x), 4096):
                        xs, ys = x[k:k + 4096], y[k:k + 4096]
                        apart = np.bitwise_count(a[start + xs] ^ b[ys]).sum(axis=1, dtype=np.int64)
                        close = apart * (100 + percent) <= size[xs, ys] * (100 - percent)
                        one, two = at[xs[close]], right_at[ys[close]]
                        new = ~(before[one] & before[two]).any(axis=1)
                        out.append(np.sort(np.stack([ids[one[new]], ids[two[new]]], axis=1), axis=1))
            found = np.concatenate([*out, np.zeros((0, 2), np.int64)])
            return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

        return dealt.groupBy("token", "i", "j").applyInArrow(join_blocks, "a long, b long")


def _joined(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(key, set, n, component_id) of every row, as ``classes`` tells."""
    join = Join(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), words, percent)
    links = join.links()
    roots = stored(smallest_reachable(links), "jaccard-roots")
    rows = join.sets.select("key", "set", "n").filter("n > 0").join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
    rows = stored(rows.select("key", "set", "n", F.coalesce("root", "set").alias("class")), "jaccard-classes")
    discard(links, roots)
    smallest = stored(rows.groupBy("class").agg(F.min("key").alias("component_id"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "jaccard-smallest")
    met = rows.join(smallest, "class", "left")
    alone = join.sets.filter("n = 0").select("key", "set", "n", F.col("key").alias("component_id"))
    component = F.when(F.col("rows").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id")
    return met.select("key", "set", "n", component).unionAll(alone)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the size of its set of shingles and the smallest key reachable by
    links, its own included.

    Null texts and texts without words have no shingles and no links; rows that repeat a text have the same class. A null
    key has the class of its text, or a null one if no row of the class has a key.
    """
    return _joined(docs, key, text, words, percent).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each_class(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its class. Rows without shingles and rows that repeat the
    smallest key stay; rows with a null key stay only in a class without other keys. Rows that repeat a key over different
    texts are told apart by their sets of shingles, which a scan of the texts hashes again."""
    found = _joined(docs, key, text, words, percent)
    dropped = found.filter(~F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key").alias("out"), F.col("set").alias("out_set"))
    dropped = stored(dropped.distinct(), "jaccard-dropped")

    @gives_back
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part, texts in slices(batch, pc.struct_field(batch.column(0), [place])):
                ids = [set_id(shingles(t, words)) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.int64())], names=["row", "key", "set"])

    # The text goes to Python once, within its row.
    place = [c.lower() for c in docs.columns].index(text.lower())
    rows = docs.select(packed(docs.columns).alias("row"), F.col(f"`{key}`").alias("key"))
    kind = T.StructType([rows.schema["row"], rows.schema["key"], T.StructField("set", T.LongType())])
    same = (F.col("set") == F.col("out_set")) & F.col("key").eqNullSafe(F.col("out"))
    return unpacked(rows.mapInArrow(named, kind).join(dropped, same, "left_anti"), "row", [])
