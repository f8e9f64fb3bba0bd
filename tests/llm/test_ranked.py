"""Ranked search against scores by plain Python."""

import math
import random
import re

import pytest

from palmares.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, top=10):
    """(item, rank, doc_id, score) by the definition, in loops over all pairs."""
    counted = [(key, terms(text)) for key, text in docs]
    counted = [(key, t) for key, t in counted if t]
    n, length = len(counted), sum(len(t) for _, t in counted)
    df = {}
    for _, t in counted:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in sorted(set(items), key=repr):
        scores = []
        for key, t in counted:
            m = 100 - 90 + (90 * len(t) * n) // length
            score = sum(weight[q] * ((1000000000 * t.count(q)) // (1000 * t.count(q) + 8 * m)) for q in set(terms(text)) if q in t)
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(k, t, "clash", 1) for k, t in docs], "doc_id long, text string, score string, m int").repartition(4)
    i = spark.createDataFrame([(k, t, "clash") for k, t in items], "item_id long, text string, rank string")
    out = ranked.search(d, i, **options)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=repr)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.7)) % 60}" for _ in range(4000)] + ["É", "日本", "X9", "rare"]
    text = lambda most: " ".join(draw.choice(words) for _ in range(draw.randrange(most)))
    docs = [(k, text(draw.choice([3, 20, 150]))) for k in range(n)]
    return draw, docs, [(k, text(30)) for k in range(12)]


@pytest.mark.parametrize("options", [{}, {"shard_postings": 40, "block_terms": 30}, {"top": 3, "shard_postings": 7}])
def test_equals_plain_scores(spark, options):
    draw, docs, items = corpus(3, 220)
    docs += [(1000 + i, docs[7][1]) for i in range(15)] + [docs[8]] * 14 + [(None, docs[9][1]), (None, docs[9][1]), (5, "other text of five w1 w2")]
    docs += [(2000, None), (2001, ""), (2002, "?! ~"), (2003, "W1 w1 " * 20000 + "É"), (2004, "\x7f\x80w1\x00É-é`rare")]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "W1 É rare X9"), (53, "W1 É rare X9"), (53, "w2"), (None, "w3 rare"), (54, "w1 " * 30000)]
    assert found(spark, docs, items, **options) == plain(docs, items, options.get("top", 10))


def test_a_third_of_all_rows_alike(spark):
    _, docs, items = corpus(5, 60)
    docs += [(7, "w1 w2 w3 rare")] * 40 + [(100 + i, "w1 w2 rare") for i in range(40)]
    assert found(spark, docs, items + [(90, "rare w3")], shard_postings=25) == plain(docs, items + [(90, "rare w3")])


def test_terms_are_counted_where_they_are_split(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a regular expression over whole texts takes most of the run")

    _, docs, items = corpus(8, 40)
    docs += [(900, None), (901, ""), (902, "?! ~"), (903, "É日本 w1\x85w1\u00a0w2"), (904, "A" * 70000 + " a")]
    monkeypatch.setattr(ranked.F, "regexp_count", refused)
    assert found(spark, docs, items + [(90, "w1\x85w1\u00a0w2")]) == plain(docs, items + [(90, "w1\x85w1\u00a0w2")])
    counted = [len(terms(t)) for _, t in docs]
    rows = spark.createDataFrame(docs, "key long, text string").repartition(3)
    assert ranked.totals(ranked.with_digests(rows, "key", "text")) == (sum(n > 0 for n in counted), sum(counted))


def test_empty_tables(spark):
    _, docs, items = corpus(6, 5)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_shards_hold_no_more_than_their_postings(spark):
    rows = spark.range(3000).selectExpr("id AS key", "id * 7 AS digest", "CAST(1 + IF(id % 3 = 0, 0, id % 50) AS LONG) AS m", "array(1, 2, 3) AS codes")
    held = ranked.sharded(rows, 500).groupBy("shard").count().collect()
    assert sum(r["count"] for r in held) == 3000 and len(held) == 18 and max(r["count"] for r in held) * 3 < 700
