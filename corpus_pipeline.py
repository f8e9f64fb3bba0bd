"""A training-data pipeline over ``documents``: language ID, exact dedup, near dedup, source mix, byte-level BPE.

Every stage takes (spark, docs, folder) and returns a frame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Sequence

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from palmares.llm import bpe, exact, jaccard, language, mixing
from palmares.llm.queries import RANKS, token_digests
from palmares.sources.files import table
from palmares.store import narrow_batches, stored


def set_aside(docs: DataFrame, added: Sequence[str]) -> dict[str, str]:
    """Other names for columns of the input that a stage would replace by its own, so that they go through."""
    return {c: f"input {c}" for c in docs.columns if c.lower() in added}


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose text has a language; texts without a letter, and null ones, go, and no others: neither the language
    nor its score decides. Without labelled rows to learn from, texts with a letter stay."""
    model = language.fit(docs)
    if not model.groups:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    own = set_aside(docs, ("lang_pred", "score"))
    found = language.identified(docs.withColumnsRenamed(own), model).filter(F.col("lang_pred") != language.UNKNOWN)
    return found.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each text stays, the one with the largest doc_id."""
    return exact.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the smallest doc_id."""
    return jaccard.one_of_each_class(docs)


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents as the mix takes them: repeated, whole, or cut at the ends of a source's quota."""
    own = set_aside(docs, ("shard", "epoch", "first_word", "n_words"))
    mix = mixing.mixed(docs.withColumnsRenamed(own), n_chars="n_chars")
    return mix.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to, one row for each row of the mix.

    They are written here, since only a write can narrow the batches of texts that executors and workers hold."""
    with narrow_batches(spark):
        return stored(token_digests(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep=["doc_id"], decoded="decoded")), "pipeline-digests")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Fitted machines, seeded places and merges have no SQL; tests/llm/test_queries.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages applied to the documents of ``folder``."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), f"pipeline-{name}")
    return docs
