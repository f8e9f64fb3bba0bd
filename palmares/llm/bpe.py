"""Byte-level BPE over whole texts, by merge replay.

Tasks take their texts about a megabyte at a time. The distinct words (matches of the pattern) that a worker has not met
yet are laid end to end, and all of them are merged together: an inverted index from the rank of a pair of neighbours to
its positions in all words yields the merges in rank order, and a merge touches its neighbours only. Words and their ids
stay in a bounded memory of the worker; when it is full, words that no later chunk has met again go. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from palmares.llm.common import gives_back, kept_by_worker

CHUNK_CHARS = 1 << 20
MEMORY_WORDS = 250_000
#: Bytes of new words merged together (one longer word is merged alone), and pairs of tokens whose rank is remembered.
LEARNT_BYTES, MEMORY_PAIRS = 1 << 18, 1 << 20

#: The usual pattern, and the same for texts up to U+024F in classes that Python's own matcher looks up in one step.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _DIGIT, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN_WORDS = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file on the driver: one token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Pairs(dict):
    """The rank of each pair of tokens asked for (the left one times 2^32 plus the right one), -1 if they do not merge."""

    def __init__(self, ranks: Mapping[bytes, int], tokens: Mapping[int, bytes]):
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, pair: int) -> int:
        found = self[pair] = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], -1)
        return found


class _Places(dict):
    """The positions of each rank, and the ranks that have some as a heap."""

    def __init__(self, places: Mapping[int, list[int]]):
        super().__init__(places)
        self.order = list(places)
        heapify(self.order)

    def __missing__(self, rank: int) -> list[int]:
        heappush(self.order, rank)
        found = self[rank] = []
        return found


class Merges:
    """The vocabulary of a worker, and the ids (as bytes of int32) of the words it has met last."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str):
        self.ranks, self.words = ranks, regex.compile(pattern)
        self.usual = pattern == USUAL
        self.tokens = {rank: token for token, rank in ranks.items()}
        letters = [bytes([b]) for b in range(256)]
        self.single = np.array([ranks[a] for a in letters], np.int32)
        self.letter_pairs = np.array([ranks.get(a + b, -1) for a in letters for b in letters], np.int32)
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.merged = _Pairs(ranks, self.tokens)

    def split(self, text: str) -> list[str]:
        if self.usual and (text.isascii() or not _BEYOND_LATIN.search(text)):
            return _LATIN_WORDS.findall(text)
        return self.words.findall(text)

    def learn(self, words: Iterable[str]) -> None:
        """Merge the given words, some ``LEARNT_BYTES`` together, and remember their ids. A word that is a token is that token."""
        pieces, size = [], 0
        for word in words:
            piece = word.encode()
            if (rank := self.ranks.get(piece)) is not None:
                self.known[word] = np.int32(rank).tobytes()
                continue
            if pieces and size + len(piece) > LEARNT_BYTES:
                self._learn(pieces)
                pieces, size = [], 0
            pieces.append((word, piece))
            size += len(piece)
        if pieces:
            self._learn(pieces)

    def _learn(self, pieces: list[tuple[str, bytes]]) -> None:
        if len(self.merged) > MEMORY_PAIRS:
            self.merged.clear()
        flat = np.frombuffer(b"".join(piece for _, piece in pieces), np.uint8).astype(np.int32)
        ends = np.cumsum([len(piece) for _, piece in pieces])
        pairs = np.append(self.letter_pairs[flat[:-1] * 256 + flat[1:]], -1)
        pairs[ends - 1] = -1
        after, before = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        after[ends - 1] = before[np.append(0, ends[:-1])] = -1
        at_rank = np.argsort(pairs, kind="stable")[np.count_nonzero(pairs < 0):]
        ranks, starts = np.unique(pairs[at_rank], return_index=True)
        places = {rank: at.tolist() for rank, at in zip(ranks.tolist(), np.split(at_rank, starts[1:]))}
        token = self._replay(self.single[flat].tolist(), pairs.tolist(), after.tolist(), before.tolist(), places)
        left = np.array(token, np.int32)
        alive = left >= 0
        ids, cuts = left[alive].tobytes(), (4 * np.cumsum(alive)[ends - 1]).tolist()
        start = 0
        for (word, _), end in zip(pieces, cuts):
            self.known[word] = ids[start:end]
            start = end

    def _replay(self, token: list, now: list, after: list, before: list, places: dict[int, list[int]]) -> list[int]:
        """``token`` after all merges, -1 where a token was swallowed by the one before it.

        ``now`` holds the rank of every position's pair with its neighbour ``after``, ``places`` the positions of a rank.
        """
        merged, places = self.merged, _Places(places)
        order = places.order
        while order:
            rank = heappop(order)
            high = rank << 32
            for at in sorted(places.pop(rank)):
                if now[at] != rank:
                    continue
                then = after[at]
                behind = after[at] = after[then]
                token[at], token[then], now[at], now[then] = rank, -1, -1, -1
                if behind >= 0:
                    before[behind] = at
                    new = now[at] = merged[high | token[behind]]
                    if new >= 0:
                        places[new].append(at)
                left = before[at]
                if left >= 0:
                    new = now[left] = merged[token[left] << 32 | rank]
                    if new >= 0:
                        places[new].append(left)
        return token

    def _forget(self, met: set[str], fresh: set[str]) -> None:
        """Keep words that were met again after they were learnt, or are now; only the latter if all are too many."""
        kept = self.again | met
        for known in ({w: ids for w, ids in self.known.items() if w in some} for some in (kept, met)):
            if len(known) + len(fresh) <= MEMORY_WORDS:
                break
        self.known, self.again = known, set()

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        split = [self.split(text) for text in texts]
        met = set().union(*split)
        fresh = met.difference(self.known)
        if len(self.known) + len(fresh) > MEMORY_WORDS:
            self._forget(met, fresh)
        else:
            self.again |= met - fresh
        self.learn(fresh)
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, words)), np.int32) for words in split]


class _Shared:
    """A broadcast vocabulary, equal to any other broadcast of the same content."""

    def __init__(self, digest: str, broadcast):
        self.digest, self.broadcast = digest, broadcast

    def __eq__(self, other) -> bool:
        return self.digest == other.digest

    def __hash__(self) -> int:
        return hash(self.digest)


@kept_by_worker
@lru_cache(maxsize=1)
def _merges(shared: _Shared, pattern: str) -> Merges:
    """One vocabulary and its words for each worker, also when later jobs broadcast it anew."""
    return Merges(shared.broadcast.value, pattern)


def _chunks(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to ``most`` or are a single row."""
    start, total = 0, 0
    for at, size in enumerate(sizes):
        if at > start and total + size > most:
            yield start, at
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _decoded(tokens: Mapping[int, bytes], ids: np.ndarray) -> bytes:
    try:
        return b"".join(map(tokens.__getitem__, ids.tolist()))
    except KeyError:
        raise ValueError("an id is not in the vocabulary") from None


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", target: str = "ids", chunk_chars: int = CHUNK_CHARS,
    keep: Sequence[str] | None = None, decoded: str | None = None,
) -> DataFrame:
    """``docs`` with the token ids of every whole text in ``target``; null and empty texts have no ids.

    ``keep`` names the columns to return beside them (all without it), so that texts need not travel back; ``decoded`` names a
    column for the bytes that the ids decode to, made in the same pass. A single word is held as five numbers for each of its
    bytes while it is merged, some 150 bytes a byte: a word of a megabyte takes 150 MB.

    The file of ranks is read by the driver and broadcast: its size is that of the vocabulary, whatever the corpus.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as file:
        digest = hashlib.file_digest(file, "sha256").hexdigest()
    shared = _Shared(digest, spark.sparkContext.broadcast(read_ranks(ranks_path)))
    added = [target] + ([decoded] if decoded else [])
    others = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in others])
    fields = [*rows.schema.fields[1:], T.StructField(target, T.ArrayType(T.IntegerType(), False))]
    kind = T.StructType(fields + ([T.StructField(decoded, T.BinaryType())] if decoded else []))

    @gives_back
    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(shared, pattern)
        for batch in batches:
            sizes = [n or 0 for n in pc.utf8_length(batch.column(0)).to_pylist()]
            for start, end in _chunks(sizes, chunk_chars):
                part = batch.slice(start, end - start)
                ids = merges.encode([x or "" for x in part.column(0).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))]
                if decoded:
                    columns.append(pa.array([_decoded(merges.tokens, x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=[*others, *added])

    return rows.mapInArrow(encode_batches, kind)


def decode(rows: DataFrame, ranks_path: str, ids: str = "ids", target: str = "decoded", chunk_ids: int = 1 << 18) -> DataFrame:
    """``rows`` with the bytes of every list of ids in ``target``; a null list gives no bytes, an unknown id fails."""
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    others = [c for c in rows.columns if c != target]
    kind = T.StructType([*rows.select(*[F.col(f"`{c}`") for c in others]).schema.fields, T.StructField(target, T.BinaryType())])

    def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in shared.value.items()}
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            counts = [n or 0 for n in pc.list_value_length(batch.column(at)).to_pylist()]
            for start, end in _chunks(counts, chunk_ids):
                part = batch.slice(start, end - start)
                out = pa.array([_decoded(tokens, np.array(x or [], np.int64)) for x in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*others, target])

    return rows.select(*[F.col(f"`{c}`") for c in others]).mapInArrow(decode_batches, kind)
