"""The whole pipeline on odd rows and on none."""

import corpus_pipeline
from palmares.store import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def through(spark, docs):
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stored(stage(spark, docs, "unused"), f"case-{name}")
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == before
        kept[name] = docs.collect()
    return kept


def test_no_documents(spark):
    kept = through(spark, spark.createDataFrame([], SCHEMA))
    assert not any(kept.values())


def test_nulls_long_words_repeated_rows_and_few_words(spark):
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "12 34 !", None, None, 7), (None, "a row without a key", "en", None, 19),
        (5, "z" * 200_000, "en", "a", 200_000), (6, "one two", "de", "b", 7), (6, "one two", "de", "b", 7), (7, "ONE two", None, "b", 7),
        (8, "alone", "fr", None, 5), (9, "one two three", "fr", "c", 13),
    ]
    kept = through(spark, spark.createDataFrame(rows, SCHEMA))
    ids = lambda name: {r["doc_id"] for r in kept[name]}
    assert ids("language_id") == {None, 5, 6, 7, 8, 9} and len(kept["language_id"]) == 7
    assert ids("exact_dedup") == {None, 5, 7, 8, 9} and len(kept["exact_dedup"]) == 5
    assert ids("near_dedup") == {None, 5, 7, 8, 9}
    words = {d["doc_id"]: len(d["text"].split()) for d in kept["near_dedup"]}
    for key, most in words.items():
        assert sum(len(r["text"].split()) for r in kept["source_mix"] if r["doc_id"] == key) <= 3 * most
    assert all(set(r.asDict()) == set(FIELDS) for r in kept["byte_bpe"])
    assert sorted(str(r["doc_id"]) for r in kept["byte_bpe"]) == sorted(str(r["doc_id"]) for r in kept["source_mix"])
