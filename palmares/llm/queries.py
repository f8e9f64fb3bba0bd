"""The corpus operators as queries over the given tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from palmares.llm import bisectors, bpe, exact, jaccard, kneser_ney, language, lexicon, mixing, nearest, ranked, sharding, substrings, urls
from palmares.llm.common import ascii_lower, small, text_or_empty
from palmares.sources.files import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


@query("op1_external_shuffle")
def external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shards(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", sharding.record_size().alias("size"), F.crc32(F.encode(text_or_empty("text"), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op4_source_mix")
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(table(spark, folder, "documents"), ["doc_id"])


@query("op5_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_digests(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep=["doc_id"], decoded="decoded"))


def token_digests(rows: DataFrame) -> DataFrame:
    joined = F.concat_ws(" ", F.transform("ids", lambda i: i.cast("string")))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op7_jaccard_join")
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents").select("doc_id", "text"))


@query(
    "op8_exact_dedup",
    """
    WITH hashed AS (
      SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
      FROM documents
    )
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, text_sha256
    FROM hashed WINDOW same AS (PARTITION BY text_sha256)
    """,
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.sha2(ascii_lower(text_or_empty("text")), 256)
    return exact.decisions(table(spark, folder, "documents"), carry={"text_sha256": digest})


@query("op2_repeated_substrings")
def repeated_substrings(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"),
        (F.octet_length(text_or_empty("text")) - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def bad_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, bad): the labels of the documents that the pages were made into."""
    bad = F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1))
    return table(spark, folder, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("bad"))


@query("op3_url_rules", urls.ORACLE)
def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.judged(table(spark, folder, "pages").select("page_id", "url"), bad_pages(spark, folder))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op6_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = language.identified(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", F.coalesce(language.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def trusted_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, quality_label): documents labelled good in quality and not toxic."""
    good = (F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)
    return table(spark, folder, "labels").groupBy("doc_id").agg(good.alias("good")).filter("good")


@query("op9_kneser_ney")
def kneser_ney_quality(spark: SparkSession, folder: str) -> DataFrame:
    good = trusted_ids(spark, folder)
    texts = table(spark, folder, "documents").select("doc_id", "lang", "text")
    docs = texts.join(small(good, good.count()), "doc_id", "left")
    return kneser_ney.judged(docs, F.col("good"), ["doc_id", "lang"], source="threshold_from", texts=texts)


@query("op10_rotated_codes")
def rotated_codes(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(table(spark, folder, "embeddings"))


@query("op11_word_bpe")
def word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_digests(lexicon.tokenised(docs, lexicon.build(docs, WORD_VOCABULARY), decoded="decoded"))


@query("op12_bisector_clusters", bisectors.oracle())
def bisector_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return bisectors.clusters(table(spark, folder, "embeddings")).drop("centroid")


@query("op13_ranked_search", ranked.oracle())
def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
