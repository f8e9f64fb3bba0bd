"""Merge replay against the tiktoken library, and back."""

import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from palmares.llm import bpe

PATTERN = public_tokenizers.PATTERN
NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
RANKS = {name: bpe.read_ranks(public_tokenizers.path(name)) for name in NAMES}
OWN = {name: tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) for name, ranks in RANKS.items()}
MERGES = {name: bpe.Merges(ranks, PATTERN) for name, ranks in RANKS.items()}

TEXTS = [
    "", " ", "Hello's world\n\n  123 456", "aaaaaaaaaaaaaaaaaaaaaaaaab" * 9, "Straße für Größe, ÀÉ ñandú 日本語 \U0001f600\U0001f600",
    "\x00\x1c\x1d\x85\xa0 x ", "<|endoftext|> <|startoftext|>", "  \t leading", "trailing   ", "'s't're'VE", "١٢٣ Ⅷ ½",
]


@pytest.mark.parametrize("name", NAMES)
def test_ids_equal_the_library(name):
    draw = random.Random(5)
    pool = "abcdeinorst  \n'.,0159ßéñüÄ日\U0001f600"
    texts = TEXTS + ["".join(draw.choice(pool) for _ in range(draw.randrange(400))) for _ in range(300)]
    assert [x.tolist() for x in MERGES[name].encode(texts)] == [OWN[name].encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn")), max_size=60))
def test_any_text_equals_the_library(text):
    assert MERGES[NAMES[0]].encode([text])[0].tolist() == OWN[NAMES[0]].encode_ordinary(text)


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    merges = bpe.Merges(RANKS[NAMES[0]], PATTERN)
    for text in ["one two three four five", "two six one"]:
        assert merges.encode([text])[0].tolist() == OWN[NAMES[0]].encode_ordinary(text)


def test_words_met_again_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 6)
    merges, learnt = bpe.Merges(RANKS[NAMES[0]], PATTERN), []
    learn = merges.learn
    monkeypatch.setattr(merges, "learn", lambda words: (learnt.append(sorted(words)), learn(words)))
    texts = ["abra kadabra", "abra one", "two three six", "abra", "kadabra zzzx zzzy zzzz zzza zzzb zzzc zzzd"]
    for text in texts:
        assert merges.encode([text])[0].tolist() == OWN[NAMES[0]].encode_ordinary(text)
        assert len(merges.known) <= 8
    assert learnt[:4] == [[" kadabra", "abra"], [" one"], [" six", " three", "two"], []]


def test_frames_round_trip(spark):
    path = public_tokenizers.path(NAMES[0])
    rows = [(i, t, "old", 7) for i, t in enumerate([*TEXTS, None, "long text " * 60_000, "again", "again"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    ids = bpe.encode(docs, path, PATTERN, chunk_chars=500)
    assert ids.columns == ["doc_id", "text", "decoded", "ids"]
    out = bpe.decode(ids, path, chunk_ids=100)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    for r in out.collect():
        text = r["text"] or ""
        assert r["ids"] == OWN[NAMES[0]].encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert bpe.decode(bpe.encode(docs.limit(0), path, PATTERN), path).collect() == []


def test_unknown_ids_fail_and_null_lists_are_empty(spark):
    path = public_tokenizers.path(NAMES[0])
    none = bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), path).first()
    assert bytes(none["decoded"]) == b""
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([([999_999],)], "ids array<int>"), path).collect()


@pytest.mark.parametrize("size", [64, 1 << 18])
def test_plain_matcher_and_batches_of_new_words(monkeypatch, size):
    """All characters that the plain matcher takes, in runs and alone, and words that do not fit a batch."""
    monkeypatch.setattr(bpe, "LEARNT_BYTES", size)
    draw = random.Random(9)
    letters = [chr(c) for c in range(0x250)]
    texts = ["".join(letters), " ".join(letters), "\n".join(letters), "a" * 3000 + " " + "ñ" * 2000] + TEXTS
    texts += ["".join(draw.choice(letters + list("  \n'stvelmrd")) for _ in range(300)) for _ in range(200)]
    for name in NAMES:
        merges = bpe.Merges(RANKS[name], PATTERN)
        assert merges.usual
        assert [x.tolist() for x in merges.encode(texts)] == [OWN[name].encode_ordinary(t) for t in texts]


def test_kept_columns_and_decoding_in_one_pass(spark):
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids string")
    out = bpe.encode(docs, public_tokenizers.path(NAMES[0]), PATTERN, keep=["doc_id"], decoded="back", chunk_chars=40)
    assert out.columns == ["doc_id", "ids", "back"]
    assert {r["doc_id"]: (r["ids"], bytes(r["back"]).decode()) for r in out.collect()} == {i: (OWN[NAMES[0]].encode_ordinary(t or ""), t or "") for i, t in enumerate([*TEXTS, None])}


def test_registered_query_equals_the_library(spark):
    import hashlib

    from palmares.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for d in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = OWN["byte_bpe_50k.tiktoken"].encode_ordinary(d["text"] or "")
        want.append((d["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((d["text"] or "").encode())))
    out = QUERIES["op5_byte_bpe"](spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, out.collect())) == sorted(want)
