"""BPE over words with an end mark, through a lexicon of frequent words in a minimal acyclic transducer.

The words of the corpus are counted; the most frequent ones are merged once and compiled into the smallest acyclic
automaton that accepts them, in which words share prefixes and suffixes. Every arc carries an output; the outputs along a
word add up to its number, and its ids lie at that number. The automaton is a flat file: Spark ships it to every executor,
whose workers map it into memory and walk all new words of a chunk through it together. Words that it lacks are merged
exactly, by rank. The lexicon only saves work, so its size and the counts change no result.

Texts are normalised and split as the vocabulary file says: NFC, lower case, runs of letters, single digits, runs of other
characters, and a few contractions; white space separates and is dropped. The texts of special tokens are found before that.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from palmares.operators.ranking import top_k
from palmares.store import new_path

#: Words in the lexicon, and the longest of them in bytes: the driver builds the automaton, so both are bounded.
LEXICON_WORDS, LEXICON_BYTES = 1 << 16, 64
#: Characters whose words are looked up together, words that a worker remembers, words counted before they are passed on.
CHUNK_CHARS, MEMORY_WORDS, COUNTED_WORDS = 1 << 19, 200_000, 100_000
#: Symbols up to which a word is merged by plain search for the least rank.
SHORT = 48

# Fixed values. The tokenizer's character tables are of other Unicode versions than Python's: letters and digits that
# Python does not know yet, lower-case forms that it lacks, and marks that the tokenizer's NFC neither orders nor composes.
MORE_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
MORE_DIGITS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
MORE_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
MORE_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
UNORDERED = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(ranges: Iterable[tuple[int, int]]) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


def _category(first: str) -> list[tuple[int, int]]:
    """The runs of code points of a general category."""
    found = np.array([unicodedata.category(chr(c))[0] == first for c in range(0x110000)] + [False])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], found]).astype(np.int8)))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def _split(letters: str, digits: str) -> re.Pattern:
    return re.compile(f"[{letters}]+|[{digits}]|'(?:[stmd]|re|ve|ll)|[^{SPACE}{letters}{digits}]+")


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    """Words of any text and of texts within 16 bits a character, marks that end what NFC may compose, and upper-case
    letters that Python does not know. Classes within 16 bits are looked up in one step."""
    letters, digits = _category("L") + MORE_LETTERS, _category("N") + MORE_DIGITS
    narrow = [[(a, min(b, 0xFFFF)) for a, b in some if a <= 0xFFFF] for some in (letters, digits)]
    marks, upper = re.compile(f"([{_ranges(UNORDERED)}])"), re.compile(f"[{''.join(map(chr, MORE_LOWER))}]")
    return _split(_ranges(letters), _ranges(digits)), _split(*map(_ranges, narrow)), marks, upper


_ASCII_WORDS, _BEYOND_LATIN = _split("a-z", "0-9"), re.compile("[^\x00-\u02ff]")


def normalised(text: str) -> str:
    """NFC, then every character in lower case by itself."""
    if text.isascii() or not _BEYOND_LATIN.search(text):
        return text.lower()
    _, _, marks, upper = _patterns()
    if not unicodedata.is_normalized("NFC", text) or marks.search(text):
        text = "".join(unicodedata.normalize("NFC", part) for part in marks.split(text))
    # Python's lower() looks around a capital sigma; the tokenizer does not.
    text = text.replace("\u03a3", "\u03c3").lower()
    return text.translate(MORE_LOWER) if upper.search(text) else text


def split_words(text: str) -> list[str]:
    """The words of a normalised text."""
    if text.isascii():
        return _ASCII_WORDS.findall(text)
    wide = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
    return _patterns()[0 if wide else 1].findall(text)


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file, read by the driver; its size is that of the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        kind, added = model["model"], model["added_tokens"]
        plain = all(t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added)
        if kind["type"] != "BPE" or not kind["end_of_word_suffix"] or kind["continuing_subword_prefix"] or kind["ignore_merges"] or not plain:
            raise ValueError(f"{path} is no BPE vocabulary of words with an end mark")
        self.ids = dict(kind["vocab"])
        self.end = kind["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in added}
        self.tokens = {i: t for t, i in (self.ids | self.specials).items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in kind["merges"]]
        #: (rank, id of the merged token) of a pair of ids
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        # Bytes that are no printable character stand as the characters from 256 on, in the order of the bytes.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = {b: chr(256 + at) for at, b in enumerate(b for b in range(256) if b not in shown)}
        letters = [hidden.get(b, chr(b)) for b in range(256)]
        self.inner, self.last = [self.ids[c] for c in letters], [self.ids[c + self.end] for c in letters]

    def merged(self, word: str) -> list[int]:
        """The ids of a word: the pair of least rank is merged first, the leftmost among equals."""
        data = word.encode()
        inner = self.inner
        token = [inner[b] for b in data[:-1]]
        token.append(self.last[data[-1]])
        return self._short(token) if len(token) <= SHORT else self._long(token)

    def _short(self, token: list[int]) -> list[int]:
        get, none = self.merges.get, (1 << 60, -1)
        found = [get(pair, none) for pair in zip(token, token[1:])]
        while found and (best := min(found)) is not none:
            at = found.index(best)
            token[at:at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = get((token[at - 1], token[at]), none)
            if at < len(found):
                found[at] = get((token[at], token[at + 1]), none)
        return token

    def _long(self, token: list[int]) -> list[int]:
        get, n = self.merges.get, len(token)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*m, at) for at in range(n - 1) if (m := get((token[at], token[at + 1])))]
        heapify(heap)
        while heap:
            rank, new, at = heappop(heap)
            then = after[at]
            if token[at] < 0 or then < 0 or get((token[at], token[then])) != (rank, new):
                continue
            behind = after[at] = after[then]
            token[at], token[then] = new, -1
            if behind >= 0:
                before[behind] = at
                if m := get((new, token[behind])):
                    heappush(heap, (*m, at))
            if (left := before[at]) >= 0 and (m := get((token[left], new))):
                heappush(heap, (*m, left))
        return [t for t in token if t >= 0]


def compiled(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """The image of the smallest transducer that maps each of the words, sorted and different, to its ids.

    Words are added in order; what lies behind the prefix that a word shares with the next one is final, and its states are
    exchanged for equal ones met before. A state is known by whether a word ends there and by its arcs.
    """
    register: dict[tuple, int] = {}
    ends, counts, arcs = [], [], []

    def settled(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if (at := register.get(key)) is None:
            at = register[key] = len(ends)
            number = int(state[0])
            for label, target in state[1]:
                arcs.append((at << 8 | label, target, number))
                number += counts[target]
            ends.append(state[0])
            counts.append(number)
        return at

    path, former = [[False, []]], b""
    for word in [*words, b""]:
        same = next((i for i, (a, b) in enumerate(zip(word, former)) if a != b), min(len(word), len(former)))
        while len(path) > same + 1:
            state = path.pop()
            path[-1][1].append((former[len(path) - 1], settled(state)))
        path.extend([False, []] for _ in word[same:])
        if word:
            path[-1][0] = True
        former = word
    root = settled(path[0])
    arcs.sort()
    table = np.array(arcs, np.int64).reshape(-1, 3)
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    flat = np.array([t for i in ids for t in i], np.int32)
    head = np.array([len(ends), len(arcs), len(words), len(flat), root], np.int64)
    parts = [head, table[:, 0], starts.astype(np.int64), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32), flat, np.array(ends, np.uint8)]
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


class Transducer:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, image: np.ndarray):
        n_states, n_arcs, n_words, n_ids, self.root = image[:40].view(np.int64).tolist()
        at = 40
        views = []
        for kind, n in ((np.int64, n_arcs), (np.int64, n_words + 1), (np.int32, n_arcs), (np.int32, n_arcs), (np.int32, n_ids), (np.uint8, n_states)):
            size = np.dtype(kind).itemsize * n
            views.append(image[at:at + size].view(kind))
            at += size
        self.arcs, self.starts, self.targets, self.outputs, self.ids, self.ends = views

    @classmethod
    def open(cls, path: str) -> Transducer:
        return cls(np.memmap(path, np.uint8, "r"))

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of every word, -1 for words that are not in the lexicon. All words take each step together."""
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        letters = np.frombuffer(b"".join(words), np.uint8)
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        walking, depth = np.arange(len(words)), 0
        done = np.full(len(words), -1, np.int64)
        while len(walking):
            over = size[walking] == depth
            ended = walking[over]
            done[ended] = np.where(self.ends[state[ended]] > 0, number[ended], -1)
            walking = walking[~over]
            key = state[walking] << 8 | letters[start[walking] + depth]
            arc = np.searchsorted(self.arcs, key)
            arc[arc == len(self.arcs)] = 0
            there = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(arc), bool)
            walking, arc = walking[there], arc[there]
            number[walking] += self.outputs[arc]
            state[walking] = self.targets[arc]
            depth += 1
        return done


class Encoder:
    """The state of a worker: vocabulary, lexicon, and the ids of the words it has met last."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known: dict[str, bytes] = {}
        # The longest text at a place counts, as longer ones come first.
        names = sorted(vocabulary.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token is a word by itself, preceded by a line break, which no word holds."""
        if self.special is None or not self.special.search(text):
            return split_words(normalised(text))
        found = []
        for at, part in enumerate(self.special.split(text)):
            found.extend(["\n" + part] if at % 2 else split_words(normalised(part)))
        return found

    def learn(self, words: Iterable[str]) -> None:
        """Look the words up together and merge those that the lexicon lacks."""
        words = list(words)
        numbers = self.lexicon.numbers([w.encode() for w in words])
        starts, ids, known = self.lexicon.starts, self.lexicon.ids, self.known
        for word, number in zip(words, numbers.tolist()):
            if number >= 0:
                known[word] = ids[starts[number]:starts[number + 1]].tobytes()
            elif word[0] == "\n":
                known[word] = np.int32(self.vocabulary.specials[word[1:]]).tobytes()
            else:
                known[word] = np.array(self.vocabulary.merged(word), np.int32).tobytes()

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        split = [self.words(text) for text in texts]
        met = set().union(*split)
        fresh = met.difference(self.known)
        if len(self.known) + len(fresh) > MEMORY_WORDS:
            self.known.clear()
            fresh = met
        self.learn(fresh)
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, words)), np.int32) for words in split]


_WHITE = re.compile("[\t-\r ]")


def pieces(text: str, most: int) -> Iterator[str]:
    """Parts of at least ``most`` characters, cut before ASCII white space, where no word and no composition goes on."""
    start = 0
    while len(text) - start > most and (cut := _WHITE.search(text, start + most)):
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def _groups(texts: Sequence[str], most: int) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and parts of texts, about ``most`` characters at a time; a longer text comes in several parts."""
    rows, parts, total = [], [], 0
    for row, text in enumerate(texts):
        for part in pieces(text, most):
            if parts and total + len(part) > most:
                yield rows, parts
                rows, parts, total = [], [], 0
            rows.append(row)
            parts.append(part)
            total += len(part)
    if parts:
        yield rows, parts


@lru_cache(maxsize=2)
def _encoder(name: str, shared) -> Encoder:
    return Encoder(shared.value, Transducer.open(SparkFiles.get(name)))


def _texts(batch: pa.RecordBatch, at: int, start: int, end: int) -> list[str]:
    return [t or "" for t in batch.column(at).slice(start, end - start).to_pylist()]


def _parts_of(batch: pa.RecordBatch, at: int, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have about ``most`` characters together, or are one text."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)).tolist()
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, bisect_left(ends, before + most + 1, start))
        yield start, end
        start = end


def word_counts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """(word, n): how often each normalised word occurs in the texts. Tasks add up what they meet before it is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = Encoder(shared.value, Transducer(np.frombuffer(compiled([], []), np.uint8))), Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for start, end in _parts_of(batch, 0, CHUNK_CHARS):
                for _, parts in _groups(_texts(batch, 0, start, end), CHUNK_CHARS):
                    for part in parts:
                        counts.update(encoder.words(part))
                    if len(counts) > COUNTED_WORDS:
                        yield rows()
        yield rows()

    found = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return found.filter(~F.startswith("word", F.lit("\n"))).groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """A vocabulary with a compiled lexicon that every executor has as the file ``name``."""

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary, words: Sequence[str]):
        keys = sorted({w.encode(): w for w in words}.items())
        image = compiled([k for k, _ in keys], [vocabulary.merged(w) for _, w in keys])
        self.name = f"lexicon-{uuid.uuid4().hex}"
        path = f"{new_path(spark, 'lexicon')}/{self.name}"
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
        try:
            out.write(bytearray(image))
        finally:
            out.close()
        spark.sparkContext.addFile(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.vocabulary, self.shared = vocabulary, spark.sparkContext.broadcast(vocabulary)


def build(docs: DataFrame, path: str, text: str = "text", words: int = LEXICON_WORDS) -> Lexicon:
    """The lexicon of the ``words`` most frequent words of all texts, of up to ``LEXICON_BYTES`` bytes each.

    Equal counts go by the word. Words met once stay out. Without texts the lexicon is empty.
    """
    vocabulary = Vocabulary(path)
    often = word_counts(docs, vocabulary, text).filter((F.col("n") > 1) & (F.octet_length("word") <= LEXICON_BYTES))
    return Lexicon(docs.sparkSession, vocabulary, [r["word"] for r in top_k(often, words, "n", ["word"]).select("word").collect()])


def tokenised(docs: DataFrame, lexicon: Lexicon, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of every whole text, and in ``decoded``, if named, the text that they decode to.

    Null and empty texts, and texts of white space alone, have no ids and decode to an empty text. Columns named like an
    added one are replaced; all others pass through. A text of any length is encoded in parts cut at white space; a stretch
    without white space is held whole, with some hundred bytes for each byte of its longest word.
    """
    added = [ids] + ([decoded] if decoded else [])
    others = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in others])
    fields = rows.schema.fields[1:] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    name, shared = lexicon.name, lexicon.shared

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared)
        for batch in batches:
            for start, end in _parts_of(batch, 0, CHUNK_CHARS):
                found = [[] for _ in range(end - start)]
                for at, parts in _groups(_texts(batch, 0, start, end), CHUNK_CHARS):
                    for row, part in zip(at, encoder.encode(parts)):
                        found[row].append(part)
                lists = [f[0] if len(f) == 1 else np.concatenate(f) for f in found]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists), pa.int32()))]
                if decoded:
                    columns.append(pa.array(decode_ids(encoder.vocabulary, lists), pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns[1:], *columns], names=[*others, *added])

    return rows.mapInArrow(encode, T.StructType(fields))


def decode_ids(vocabulary: Vocabulary, lists: Iterable[np.ndarray]) -> list[str]:
    """The tokens of every list of ids joined by one space; ids that the vocabulary lacks are passed over."""
    token = vocabulary.tokens
    try:
        return [" ".join(map(token.__getitem__, ids.tolist())) for ids in lists]
    except KeyError:
        return [" ".join(token[i] for i in ids.tolist() if i in token) for ids in lists]


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", target: str = "decoded", chunk_ids: int = 1 << 20) -> DataFrame:
    """``rows`` with the text of every list of ids in ``target``; a null list gives an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    others = [c for c in rows.columns if c.lower() != target.lower()]
    lists = rows.select(F.coalesce(F.col(f"`{ids}`"), F.array()).cast("array<int>").alias("_ids"), *[F.col(f"`{c}`") for c in others])
    kind = T.StructType([*lists.schema.fields[1:], T.StructField(target, T.StringType())])

    def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)).tolist()
            start = 0
            while start < len(ends):
                end = max(start + 1, bisect_left(ends, (ends[start - 1] if start else 0) + chunk_ids + 1, start))
                part = batch.slice(start, end - start)
                texts = decode_ids(shared.value, [np.array(x or [], np.int64) for x in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*others, target])
                start = end

    return lists.mapInArrow(decode_batches, kind)
