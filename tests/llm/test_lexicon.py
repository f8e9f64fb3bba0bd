"""Word BPE through a lexicon against the tokenizers library, and the lexicon itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from palmares.llm import lexicon
from palmares.llm.queries import QUERIES, WORD_VOCABULARY

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
VOCABULARY = lexicon.Vocabulary(WORD_VOCABULARY)


def image(words):
    keys = sorted({w.encode() for w in words})
    return lexicon.Transducer(np.frombuffer(lexicon.compiled(keys, [VOCABULARY.merged(k.decode()) for k in keys]), np.uint8))


def library_ids(texts):
    return [e.ids for e in LIBRARY.encode_batch(list(texts), add_special_tokens=False)]


@pytest.mark.parametrize("words", [[], ["the", "there", "thing", "éa", "1", "!!"]])
def test_all_characters_equal_the_library(words):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(letters[at:at + 50]) for at in range(0, len(letters), 50)]
    encoder = lexicon.Encoder(VOCABULARY, image(words))
    assert [x.tolist() for x in encoder.encode(texts)] == library_ids(texts)


PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "Σ", "İ", " ", "\n", "\x1c", "́", "߽", "\U00011935\U00011930", "가", "12", "!!", "ß", "\U0001f600"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=8)), max_size=20))
def test_any_text_equals_the_library(parts):
    text = "".join(parts)
    encoder = lexicon.Encoder(VOCABULARY, image(["the", "s"]))
    assert encoder.encode([text])[0].tolist() == library_ids([text])[0]
    cut = list(lexicon.pieces(text, 3))
    assert "".join(cut) == text and [i for x in encoder.encode(cut) for i in x.tolist()] == library_ids([text])[0]


def test_long_words_equal_the_library():
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdegint") for _ in range(draw.randrange(1, 3000))) for _ in range(60)] + ["a" * 5000, "=" * 4097, "é" * 999]
    assert [VOCABULARY.merged(w) for w in words] == library_ids(words)
    assert [VOCABULARY._long([*(VOCABULARY.inner[b] for b in w.encode()[:-1]), VOCABULARY.last[w.encode()[-1]]]) for w in words] == library_ids(words)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6)), st.sets(st.binary(max_size=6)))
def test_the_transducer_maps_its_words_and_no_others(words, others):
    keys = sorted(words)
    found = lexicon.Transducer(np.frombuffer(lexicon.compiled(keys, [[len(k), k[0]] for k in keys]), np.uint8))
    assert found.numbers(keys).tolist() == list(range(len(keys)))
    assert all((n >= 0) == (w in words) for w, n in zip(sorted(others), found.numbers(sorted(others)).tolist()))
    assert [found.ids[found.starts[n]:found.starts[n + 1]].tolist() for n in range(len(keys))] == [[len(k), k[0]] for k in keys]


def test_the_transducer_is_minimal():
    # Two first letters, one shared end: prefixes and suffixes are kept once.
    found = image(["talking", "walking", "talks", "walks"])
    assert (len(found.ends), len(found.arcs)) == (8, 9)


ODD = ["", None, " \n\t", "Hello <|endoftext|> World's", "x " * 400_000, "y" * 50_000, "Ünïcödé ΑΣ 12", "Hello <|endoftext|> World's", "\U0001f600" * 50]


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "CHUNK_CHARS", 1000)
    rows = [(i if i != 3 else None, t, "clash", i) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string, number long").repartition(3)
    built = lexicon.build(docs, WORD_VOCABULARY)
    out = lexicon.tokenised(docs, built, decoded="decoded")
    assert out.columns == ["doc_id", "text", "number", "ids", "decoded"]
    want = library_ids(t or "" for t in ODD)
    found = {r["number"]: (r["text"], r["ids"], r["decoded"]) for r in out.collect()}
    assert found == {i: (t, want[i], LIBRARY.decode(want[i], skip_special_tokens=False)) for i, t in enumerate(ODD)}
    again = lexicon.decode(lexicon.tokenised(docs, built), VOCABULARY)
    assert {r["number"]: r["decoded"] for r in again.collect()} == {i: f[2] for i, f in found.items()}
    empty = docs.limit(0)
    assert lexicon.tokenised(empty, lexicon.build(empty, WORD_VOCABULARY), decoded="decoded").collect() == []
    odd_ids = spark.createDataFrame([(1, [0, 999_999]), (2, None)], "number long, ids array<int>")
    assert sorted((r["number"], r["decoded"]) for r in lexicon.decode(odd_ids, VOCABULARY).collect()) == [(1, "!"), (2, "")]


def test_word_counts(spark):
    docs = spark.createDataFrame([("a B b",), ("b, a!",), (None,), ("<|endoftext|>",)], "text string")
    assert {r["word"]: r["n"] for r in lexicon.word_counts(docs, VOCABULARY).collect()} == {"a": 2, "b": 3, ",": 1, "!": 1}


def test_registered_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = [(d["doc_id"], len(i), sha(" ".join(map(str, i))), sha(LIBRARY.decode(i, skip_special_tokens=False))) for d, i in zip(docs, library_ids(d["text"] or "" for d in docs))]
    out = QUERIES["op11_word_bpe"](spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, out.collect())) == sorted(want)
