"""Ranked lexical search through an index stratified by length.

The weight of a term in a document depends on its count there and on the document's length only through a whole number m.
Documents with the same m form a stratum; in it the postings of a term are kept by count, so that the impact of a count is
computed once. The largest count bounds what a term can add there, and the sum of these bounds over the terms of a query
bounds every document of the stratum: strata are visited by falling bound until the next one cannot reach the last place.

The index is cut into shards of about equal numbers of postings along m. A stratum that spans several shards deals its
documents by hash, and equal rows of one document are counted first, so no task holds more than a shard. Every shard
returns a bounded number of documents for each query. Queries go through in blocks of bounded vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from palmares.llm.common import running_start
from palmares.operators.ranking import number_rows, top_k_per_group
from palmares.store import discard, stored

TOP = 10
#: Terms of a block of queries (a query is never cut), and postings of a shard.
BLOCK_TERMS, SHARD_POSTINGS = 1 << 20, 1 << 20
#: Slope of the length normaliser in hundredths, and the scale of impacts.
SLOPE, SATURATION, SCALE = 90, 8, 1_000_000_000
#: Every byte that belongs to no term becomes a space, A-Z becomes a-z. Bytes from 0x80 on belong to characters beyond ASCII.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
CHUNK_BYTES = 1 << 22


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(_BYTES).split()


def with_digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, text): every row with a hash of its text."""
    return docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("digest"), F.col(f"`{text}`").cast("binary").alias("text"))


def totals(rows: DataFrame) -> tuple[int, int]:
    """The number of rows that hold a term, and of all their terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = length = 0
        for batch in batches:
            for text in batch.column(0):
                n = len(terms_of(text.as_py() or b""))
                documents += n > 0
                length += n
        yield pa.RecordBatch.from_pydict({"documents": [documents], "length": [length]})

    found = rows.select("text").mapInArrow(count, "documents long, length long")
    return tuple(found.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("documents", "length")]).first())


def query_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term), each once: rows that repeat a key with the same text are one query, other texts of the key are queries of their own."""
    pairs = items.select(F.struct(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("digest")).alias("item"), F.col(f"`{text}`").cast("string").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(at, term) for at, text in enumerate(batch.column(1).to_pylist()) for term in set(terms_of((text or "").encode()))]
            rows, terms = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.binary())], names=["item", "term"])

    kind = pairs.schema["item"].dataType.simpleString()
    return pairs.mapInArrow(split, f"item {kind}, term binary").distinct()


def documents_of(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(key, digest, n, copies, codes, counts): the asked terms of every document that holds any, equal rows once."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value.get
        for batch in batches:
            rows, sizes, lists, tallies = [], [], [], []
            size = 0

            def held() -> pa.RecordBatch:
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
                flat = [pa.array(np.concatenate([np.fromiter(x, np.int64, len(x)) for x in some]), kind) for some, kind in ((lists, pa.int32()), (tallies, pa.int64()))]
                columns = [batch.column(i).take(pa.array(rows)) for i in (0, 1)]
                return pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), *[pa.ListArray.from_arrays(offsets, f) for f in flat]], names=["key", "digest", "n", "codes", "counts"])

            for at in range(batch.num_rows):
                data = batch.column(2)[at].as_py()
                if not data:
                    continue
                size += len(data)
                terms = terms_of(data)
                found = Counter(map(code, terms))
                found.pop(None, None)
                if found:
                    rows.append(at)
                    sizes.append(len(terms))
                    lists.append(found.keys())
                    tallies.append(found.values())
                if rows and size > CHUNK_BYTES:
                    yield held()
                    rows, sizes, lists, tallies, size = [], [], [], [], 0
            if rows:
                yield held()

    key = docs.schema["key"].dataType.simpleString()
    kind = f"key {key}, digest long, n long, codes array<int>, counts array<long>"
    found = docs.select("key", "digest", "text").mapInArrow(count, kind)
    return found.groupBy("key", "digest", "n").agg(F.count(F.lit(1)).alias("copies"), F.first("codes").alias("codes"), F.first("counts").alias("counts"))


def normaliser(n: str, documents: int, length: int) -> Column:
    """m of a document of ``n`` terms among ``documents`` with ``length`` terms in all, in 64-bit whole numbers."""
    return F.expr(f"{100 - SLOPE} + ({SLOPE} * `{n}` * {documents}L) div {length}L")


def sharded(rows: DataFrame, postings: int) -> DataFrame:
    """``rows`` with their ``shard``. Every stratum takes a stretch as long as its postings on a line cut into shards; its
    documents lie along the stretch by hash."""
    sizes = rows.groupBy("m").agg(F.sum(F.size("codes")).cast("long").alias("held"))
    sizes = number_rows(sizes, ["m"], "at")
    sizes = stored(running_start(sizes, "held", "at", "start").select("m", "held", "start"), "ranked-strata")
    place = F.pmod(F.xxhash64(F.lit(7), "key", "digest"), F.lit(1 << 30)) / (1 << 30)
    return rows.join(sizes, "m").withColumn("shard", F.floor((F.col("start") + F.floor(place * F.col("held"))) / postings).cast("long")).drop("held", "start")


class Shard:
    """The index of one shard: postings by term, stratum and count, and what each term can add at most in each stratum."""

    def __init__(self, m: np.ndarray, codes: Sequence[np.ndarray], counts: Sequence[np.ndarray]):
        document = np.repeat(np.arange(len(m)), [len(c) for c in codes])
        code, tf = np.concatenate(codes), np.concatenate(counts).astype(np.int64)
        self.m, stratum = np.unique(m, return_inverse=True)
        self.size, self.sizes = len(m), np.bincount(stratum, minlength=len(self.m))
        order = np.lexsort((document, -tf, stratum[document], code))
        self.document, code, tf = document[order].astype(np.int64), code[order], tf[order]
        stratum = stratum[self.document]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (stratum[1:] != stratum[:-1]) | (tf[1:] != tf[:-1])
        self.group_starts = np.flatnonzero(new)
        # One impact for each count of a term in a stratum, the largest count first.
        tf = tf[self.group_starts]
        impact = SCALE * tf // (1000 * tf + SATURATION * self.m[stratum[self.group_starts]])
        self.impact = np.repeat(impact, np.diff(np.append(self.group_starts, len(code))))
        code, stratum = code[self.group_starts], stratum[self.group_starts]
        first = np.ones(len(code), bool)
        first[1:] = (code[1:] != code[:-1]) | (stratum[1:] != stratum[:-1])
        at = np.flatnonzero(first)
        self.entry_code, self.entry_stratum, self.entry_most = code[at], stratum[at], impact[at]
        self.entry_starts = np.append(self.group_starts[at], len(self.document))

    def best(self, codes: np.ndarray, weights: np.ndarray, top: int, copies: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``top`` best rows for one query, ``order`` deciding between equal scores."""
        low, high = np.searchsorted(self.entry_code, codes), np.searchsorted(self.entry_code, codes, "right")
        stretches = [(a, b, w) for a, b, w in zip(low.tolist(), high.tolist(), weights.tolist()) if b > a and w > 0]
        bound = np.zeros(len(self.m), np.int64)
        for a, b, w in stretches:
            bound[self.entry_stratum[a:b]] += w * self.entry_most[a:b]
        visit = np.argsort(-bound, kind="stable")
        visit = visit[bound[visit] > 0]
        found, scores, line, start = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0
        wanted = 4 * top
        while start < len(visit) and bound[visit[start]] >= line:
            # Strata are taken in the order of their bounds, at first few documents at a time.
            end = start + 1 + int(np.searchsorted(np.cumsum(self.sizes[visit[start:]]), wanted))
            chosen = np.zeros(len(self.m), bool)
            some = visit[start:end]
            chosen[some[bound[some] >= line]] = True
            score = np.zeros(self.size, np.int64)
            for a, b, w in stretches:
                entries = a + np.flatnonzero(chosen[self.entry_stratum[a:b]])
                begin, size = self.entry_starts[entries], self.entry_starts[entries + 1] - self.entry_starts[entries]
                if len(entries) == b - a:
                    at = slice(self.entry_starts[a], self.entry_starts[b])
                else:
                    ends = np.cumsum(size)
                    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
                score[self.document[at]] += w * self.impact[at]
            more = np.flatnonzero(score >= line)
            found, scores = np.concatenate([found, more]), np.concatenate([scores, score[more]])
            if len(found) > top:
                keep = np.lexsort((order[found], -scores))[:top]
                found, scores = found[keep], scores[keep]
            if len(found) == top:
                line = int(scores.min())
            start, wanted = end, wanted * 8
        keep = np.lexsort((order[found], -scores))
        found, scores = found[keep], scores[keep]
        return np.repeat(found, copies[found])[:top], np.repeat(scores, copies[found])[:top]


def _searcher(queries: Sequence[tuple[int, list[int], list[int]]], top: int):
    """Searches one shard, given as a table of its documents, for all queries (item, codes, weights)."""

    def search_shard(table: pa.Table) -> pa.Table:
        lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column("codes"), table.column("counts"))]
        codes, counts = (np.split(c.flatten().to_numpy(), np.cumsum(pc.list_value_length(c).to_numpy())[:-1]) for c in lists)
        keys = table.column("key")
        # Equal scores go by the key, rows without one last.
        place = np.empty(table.num_rows, np.int64)
        place[pc.sort_indices(table.select(["key", "digest"]), [("key", "ascending"), ("digest", "ascending")]).to_numpy()] = np.arange(table.num_rows)
        shard, copies = Shard(table.column("m").to_numpy(), codes, counts), np.minimum(table.column("copies").to_numpy(), top)
        items, documents, scores = [], [], []
        for item, wanted, weights in queries:
            document, score = shard.best(np.array(wanted), np.array(weights, np.int64), top, copies, place)
            items.append(np.full(len(document), item))
            documents.append(document)
            scores.append(score)
        at = np.concatenate(documents).astype(np.int64)
        return pa.table({"item": pa.array(np.concatenate(items).astype(np.int64)), "key": keys.take(pa.array(at)), "score": pa.array(np.concatenate(scores).astype(np.int64))})

    return search_shard


def _weights(rows: DataFrame, documents: int) -> DataFrame:
    """(code, weight) of the asked terms that a document holds."""
    held = rows.select(F.explode("codes").alias("code"), "copies").groupBy("code").agg(F.sum("copies").alias("df"))
    return held.select("code", F.floor(1000 * F.log((F.lit(2.0) * documents + 2) / (2 * F.col("df") + 1))).alias("weight"))


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", item: str = "item_id", text: str = "text",
    block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """(item, rank, key, score): of every query the ``top`` documents with the largest scores above 0, ties to the smaller key.

    Every row of ``docs`` is a document, repeated ones too; a document without a key comes after others of its score. Null
    and empty texts have no terms: as documents they count nowhere, as queries they find nothing. Queries that repeat are
    one. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    rows = with_digests(docs, key, text)
    documents, length = totals(rows)
    asked = query_terms(items, item, text)
    numbered = number_rows(asked.groupBy("item").agg(F.count(F.lit(1)).alias("terms")), ["item"], "number")
    numbered = stored(running_start(numbered, "terms", "number", "start").withColumn("block", F.floor(F.col("start") / block_terms)), "ranked-items")
    asked = stored(asked.join(numbered.select("item", "number", "block"), "item"), "ranked-terms", ["block"])
    blocks, result = [r["block"] for r in asked.select("block").distinct().orderBy("block").collect()], None
    for block in blocks if documents else []:
        part = _search_block(rows, asked.filter(F.col("block") == block).select("number", "term"), documents, length, top, shard_postings)
        result = part if result is None else result.unionByName(part)
    kind = docs.schema[key].dataType.simpleString()
    if result is None:
        return spark.createDataFrame([], f"`{item}` {items.schema[item].dataType.simpleString()}, rank int, `{key}` {kind}, score long")
    named = numbered.select(F.col("number").alias("item"), F.col("item.key").alias("name"))
    out = result.join(named, "item")
    return out.select(F.col("name").alias(item), F.col("rank").cast("int"), F.col("key").alias(key), "score")


def _search_block(rows: DataFrame, asked: DataFrame, documents: int, length: int, top: int, postings: int) -> DataFrame:
    """(item, rank, key, score) for the queries of one block. Their terms, bounded by the block, are what the driver holds."""
    terms = asked.toArrow()
    words = terms.column("term").unique().to_pylist()
    vocabulary = {w: at for at, w in enumerate(words)}
    held = documents_of(rows, vocabulary).withColumn("m", normaliser("n", documents, length))
    held = stored(held, "ranked-documents")
    weight = {r["code"]: r["weight"] for r in _weights(held, documents).collect()}
    wanted: dict[int, tuple[list[int], list[int]]] = {}
    for number, term in zip(terms.column("number").to_pylist(), terms.column("term").to_pylist()):
        if (code := vocabulary[term]) in weight:
            codes, weights = wanted.setdefault(number, ([], []))
            codes.append(code)
            weights.append(weight[code])
    kind = held.schema["key"].dataType.simpleString()
    queries = [(number, *lists) for number, lists in sorted(wanted.items())]
    index = sharded(held, postings).select("shard", "key", "digest", "m", "copies", "codes", "counts")
    found = index.groupBy("shard").applyInArrow(_searcher(queries, top), f"item long, key {kind}, score long")
    best = stored(_ranked(found, top), "ranked-best")
    discard(held)
    return best


def _ranked(found: DataFrame, top: int) -> DataFrame:
    # Rows without a key come last: ties are by whether the key is missing, then by the key.
    return top_k_per_group(found.withColumn("missing", F.col("key").isNull()), ["item"], top, "score", ["missing", "key"]).drop("missing")


def oracle(top: int = TOP) -> str:
    """DuckDB SQL for the rows of ``search`` over keys that do not repeat."""
    split = lambda table, key: f"""SELECT {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM {table}"""
    return f"""
    WITH terms AS ({split('documents', 'doc_id')}),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
    lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
    whole AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM lengths),
    weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(total) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, whole GROUP BY term),
    norms AS (SELECT doc_id, {100 - SLOPE} + ({SLOPE} * n * total) // length AS m FROM lengths, whole),
    asked AS (SELECT DISTINCT item_id, term FROM ({split('benchmark', 'item_id')})),
    scores AS (SELECT item_id, doc_id, sum(w * (({SCALE} * tf) // (1000 * tf + {SATURATION} * m)))::BIGINT AS score
      FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores
    WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {top}"""
