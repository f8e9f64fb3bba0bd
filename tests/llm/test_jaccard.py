"""The shingle join against all pairs in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from palmares.llm import jaccard
from palmares.llm.components import smallest_reachable

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, component_id string, n int, token string"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    size = min(5, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if size else frozenset()


def brute_force(rows):
    sets = [(key, plain_set(text)) for key, text in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    smallest = {}
    for i, (key, _) in enumerate(sets):
        if key is not None:
            smallest[find(i)] = min(key, smallest.get(find(i), key))
    return Counter((key, len(s), smallest.get(find(i)) if s else key) for i, (key, s) in enumerate(sets))


def documents(seed, n, passage=0):
    """Chains of edited copies, shared passages, and texts near the threshold."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdef") for _ in range(3))
    shared = [word() for _ in range(40)]
    texts = [[word() for _ in range(draw.choice([3, 5, 8, 40, 120]))] for _ in range(n // 4)]
    while len(texts) < n:
        text = list(draw.choice(texts))
        for _ in range(draw.choice([0, 1, 1, 2, 4])):
            text[draw.randrange(len(text))] = word()
        texts.append(text)
    out = []
    for i, text in enumerate(texts):
        body = text + shared if passage and i % passage == 0 else text
        out.append((i + 100, " ".join(w.upper() if draw.random() < 0.05 else w for w in body)))
    return out


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, "x " * 30_000), (8, "x " * 500), (9, "Ä b c d e"),
       (9, "ä b c d e"), (9, "Ä b c d e"), (None, "one two"), (None, "nobody else"), (10, "a a a a a a"), (11, "a a a a a")]


@pytest.mark.parametrize(("rows", "few", "block"), [
    (documents(1, 160) + ODD, 64, 1024), (documents(2, 160, 2), 2, 16), (ODD, 64, 1024), ([], 64, 1024), ([(1, None)], 64, 1024),
])
def test_classes_equal_all_pairs(spark, monkeypatch, rows, few, block):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = spark.createDataFrame([(*r, "clash", 1, "t") for r in rows], SCHEMA)
    found = jaccard.classes(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(tuple(r) for r in found.collect()) == brute_force(rows)


def test_one_of_each_class_stays_with_its_columns(spark):
    rows = documents(3, 80) + [(1, None), (2, "")]
    docs = spark.createDataFrame([(*r, "clash", 1, "t") for r in rows], SCHEMA)
    left = jaccard.one_of_each_class(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, _, c in brute_force(rows)})


def test_one_of_each_class_tells_rows_of_one_key_apart(spark):
    rows = documents(6, 40) + ODD + [(7, "nobody has this either"), (5, "one two three"), (5, None), (None, None), (100, "only here")]
    group = {i: c for i, _, c in brute_force([(i, text) for i, (_, text) in enumerate(rows)])}
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[group[i]] = min(key, smallest.get(group[i], key))
    want = Counter(r for i, r in enumerate(rows) if not plain_set(r[1]) or r[0] == smallest.get(group[i]))
    assert want[(None, "nobody else")] and want[(7, "nobody has this either")] and not want[(None, "one two")]
    docs = spark.createDataFrame([(*r, "clash", 1, "t") for r in rows], SCHEMA)
    left = jaccard.one_of_each_class(docs)
    assert left.schema == docs.schema
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == want


def test_sketches_never_rule_out_a_link():
    draw = np.random.default_rng(5)
    for _ in range(300):
        base = draw.integers(0, 1 << 63, draw.integers(1, 400), dtype=np.uint64)
        a = np.unique(base)
        b = np.unique(np.concatenate([base[draw.random(len(base)) < 0.9], draw.integers(0, 1 << 63, 1 + len(base) // 12, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert jaccard.may_link(jaccard.sketch(a), jaccard.sketch(b), len(a) + len(b), 75)
            rare = np.zeros(16, np.uint8)
            assert len(np.intersect1d(jaccard.prefix(a, rare), jaccard.prefix(b, rare)))


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201), (201, 200)]
    found = {r["node"]: r["root"] for r in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pairs_that_share_several_large_regions_come_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    made, plain = [], jaccard.Join._many

    def seen(self, left):
        made.append(jaccard.stored(plain(self, left)))
        return made[-1]

    monkeypatch.setattr(jaccard.Join, "_many", seen)
    draw = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for key in range(60):
        words = list(base)
        for _ in range(2):
            words[draw.randrange(40)] = f"x{draw.randrange(1000)}"
        rows.append((key, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.classes(docs).collect()) == brute_force(rows)
    assert made[0].count() == made[0].distinct().count() > 0
