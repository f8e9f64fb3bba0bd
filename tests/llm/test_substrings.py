"""Repeated strings against sets of all strings in plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from palmares.llm import substrings

SCHEMA = "doc_id long, text string, kept string, row long, spans int"


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s:s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if seen[d[s:s + length]] > 1:
                gone[s:s + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((bytes(np.frombuffer(d, np.uint8)[~gone]), tuple(zip(edges[::2].tolist(), edges[1::2].tolist()))))
    return out


def documents(seed, n):
    draw = random.Random(seed)
    text = lambda k: "".join(draw.choice("abcä ") for _ in range(k))
    passage = [text(60) for _ in range(3)]
    out = []
    for i in range(n):
        body = text(draw.randrange(120))
        if i % 3 == 0:
            body += draw.choice(passage)[draw.randrange(20):] + text(draw.randrange(40))
        if i % 7 == 0:
            body += "xy" * draw.randrange(40)
        if i % 11 == 0 and out:
            body = draw.choice(out)
        out.append(body)
    return out + ["", None, " ", "q" * 5000, "ab" * 300]


@pytest.mark.parametrize(("seed", "limit", "shard"), [(1, 2048, 1 << 19), (2, 2048, 500), (3, 2, 1 << 19)])
def test_kept_bytes_equal_plain_python(spark, seed, limit, shard):
    texts = documents(seed, 60)
    docs = spark.createDataFrame([(i % 50, t, "clash", 1, 2) for i, t in enumerate(texts)], SCHEMA)
    out = substrings.without_repeats(docs, length=24, gram=12, limit=limit, shard_bytes=shard)
    assert out.columns == ["doc_id", "text", "row", "spans", "kept", "removed"]
    got = Counter((r["doc_id"], r["text"], bytes(r["kept"]), tuple((s["start"], s["end"]) for s in r["removed"])) for r in out.collect())
    assert got == Counter((i % 50, t, *p) for i, (t, p) in enumerate(zip(texts, plain(texts, 24))))


def test_empty_table_and_single_rows(spark):
    assert substrings.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, None, None, None), (None, "short", None, None, None)]
    assert {bytes(r["kept"]) for r in substrings.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()} == {b"", b"short"}


def test_rows_that_repeat_key_and_text_remove_each_other(spark):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(300))
    out = substrings.without_repeats(spark.createDataFrame([(1, text), (1, text), (2, text[:210] + "!")], "doc_id long, text string")).collect()
    assert sorted(bytes(r["kept"]) for r in out) == [b"", b"", b"!"]


def test_backward_extension_derives_common_prefixes():
    draw = random.Random(9)
    for _ in range(60):
        codes = np.array([draw.randrange(1, 4) for _ in range(draw.randrange(2, 200))] + [0])
        length = draw.choice([1, 2, 3, 5, 9])
        order = substrings.suffix_array(codes, length)
        heads = [tuple(codes[i:i + length]) for i in order]
        assert heads == sorted(heads)
        assert substrings.told_apart(codes, order, length).tolist() == [True] + [a != b for a, b in zip(heads, heads[1:])]


def test_segments_split_all_strings_by_anchor():
    data = np.frombuffer(("".join(random.Random(2).choice("ab") for _ in range(3000)) + "a" * 500).encode(), np.uint8)
    anchor, digest, first, last = substrings.segments(data, 40, 20)
    assert first[0] == 0 and last[-1] == len(data) - 40 and (first[1:] == last[:-1] + 1).all()
    of_string = {}
    for a, f, l in zip(anchor, first, last):
        for s in range(f, l + 1):
            assert of_string.setdefault(data[s:s + 40].tobytes(), a) == a
