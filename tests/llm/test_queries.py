"""The registered corpus queries: SQL where there is any, shapes, URL rules, and the pipeline against plain Python."""

import random
import re
from itertools import combinations

import compare
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from palmares.llm import bpe, urls
from palmares.llm.queries import QUERIES, RANKS, SQL

FOLDER = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, duck, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), duck, SQL[name]) == []


def test_url_filters_are_native(spark):
    plan = QUERIES["op3_url_rules"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


URLS = [
    ("https://a.org/x", "a.org", "/x", "org/", "allow"), ("HTTP://WWW.Example.ORG/es/1?q=1", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("x://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"), ("x://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("x://a.com/fr/1", "a.com", "/fr/1", "com/fr/", "allow"), ("x://a.com/de/1", "a.com", "/de/1", "com/de/", "block"), ("x://a.com/en", "a.com", "/en", None, "allow"),
    ("x://org", "org", "", None, "allow"), ("x://a.org?b/c://d", "a.org", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("x://", "", "", None, "allow"), ("", "", "", None, "allow"),
]


def test_given_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "clash", "t") for i, u in enumerate(URLS)], "page_id long, url string, host string, mined string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    out = urls.judged(pages, none)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "mined"]
    found = {r["page_id"]: (r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert [found[i] for i in range(len(URLS))] == URLS
    assert urls.judged(pages.limit(0), none).collect() == []


def test_mined_token_sets_block(spark):
    rows = [(i, f"x://spam{i % 3}.net/{'buy' if i % 2 else 'read'}/{i}", i % 2 == 1 or i % 3 == 0) for i in range(120)]
    pages = spark.createDataFrame([r[:2] for r in rows] + [(500, "x://new.net/buy/1"), (501, "x://spam0.net/z"), (502, "x://spam1.net/read")], "page_id long, url string")
    labels = spark.createDataFrame([(i, bad) for i, _, bad in rows] + [(900, True)], "page_id long, bad boolean")
    verdict = {r["page_id"]: r["verdict"] for r in urls.judged(pages, labels, min_confidence=0.9).collect()}
    assert verdict[500] == "block" and verdict[501] == "block" and verdict[502] == "allow"
    assert all((verdict[i] == "block") == bad for i, _, bad in rows)
    mined = urls.mined_rules(spark.createDataFrame([(["a", "b"], True)] * 9 + [(["a"], False)] * 9 + [(["b"], True)] * 3, "tokens array<string>, bad boolean"), min_confidence=0.5)
    assert {(tuple(r["rule_tokens"]), r["confidence"]) for r in mined.collect()} == {(("a",), 0.5), (("b",), 1.0)}


def test_mined_rules_of_any_size_equal_brute_force(spark):
    draw = random.Random(4)
    rows = []
    for _ in range(400):
        tokens = sorted(t for t in "abcdef" if draw.random() < 0.5)
        rows.append((tokens, draw.random() < (0.9 if {"a", "b", "c"} <= set(tokens) else 0.95 if {"b", "d", "e", "f"} <= set(tokens) else 0.2)))
    share = {}
    for size in range(1, 7):
        for rule in combinations("abcdef", size):
            marks = [bad for tokens, bad in rows if set(rule) <= set(tokens)]
            if sum(marks) >= 5 and sum(marks) / len(marks) >= 0.5:
                share[rule] = sum(marks) / len(marks)
    want = {r: c for r, c in share.items() if not any(set(o) < set(r) and d >= c for o, d in share.items())}
    found = urls.mined_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_confidence=0.5).collect()
    assert {tuple(r["rule_tokens"]): pytest.approx(r["confidence"]) for r in found} == want and len(found) == len(want)
    assert max(map(len, want)) >= 3
    pages = [(i, f"x://h{i % 2}.net/{'s' if i & 2 else 'r'}/{'p' if i & 4 else 'q'}/{i}") for i in range(160)]
    labels = spark.createDataFrame([(i, i % 8 == 7) for i in range(160)], "page_id long, bad boolean")
    judged = urls.judged(spark.createDataFrame(pages, "page_id long, url string"), labels, min_confidence=0.9).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 8 == 7) for r in judged)


def test_deep_common_paths_are_mined_as_one_item(spark):
    deep = "/".join(f"d{k}" for k in range(30))
    nested = ["/".join(f"n{k}" for k in range(1 + i)) for i in range(24)]
    rows = [(i, f"x://deep.net/{deep}/{i}", i % 4 > 0) for i in range(40)]
    rows += [(100 + i, f"x://nest.net/{nested[i % 24]}/{i}", i % 24 > 11) for i in range(240)]
    rows += [(1000 + i, f"x://good.net/{i % 5}/{i}", False) for i in range(50)]
    pages = spark.createDataFrame([r[:2] for r in rows] + [(2000, "x://new.org.net/z/d17/a"), (2001, "x://nest.net/n0/n1")], "page_id long, url string")
    labels = spark.createDataFrame([(i, bad) for i, _, bad in rows], "page_id long, bad boolean")
    verdict = {r["page_id"]: r["verdict"] for r in urls.judged(pages, labels, min_confidence=0.7).collect()}
    assert all(verdict[i] == "block" for i in range(40)) and verdict[2000] == "block" and verdict[2001] == "allow"
    # The piece n<k> is bad in 12 of the 24 - k kinds of rows that hold it: at least 0.7 from n7 on.
    assert all((verdict[i] == "block") == ((i - 100) % 24 >= 7) for i in range(100, 340))
    assert all(verdict[i] == "allow" for i, _, _ in rows if i >= 1000)


def test_equal_and_nested_tokens_give_the_rules_of_brute_force(spark):
    draw = random.Random(8)
    rows = []
    for _ in range(300):
        tokens = {t for t in "adef" if draw.random() < 0.6} | {"u"}
        tokens |= {"b", "c"} if "a" in tokens and draw.random() < 0.8 else {"g"} if draw.random() < 0.5 else set()
        rows.append((sorted(tokens), draw.random() < 0.15 + 0.2 * len(tokens & {"b", "d", "e"})))
    share = {}
    for size in range(1, 9):
        for rule in combinations("abcdefgu", size):
            marks = [bad for tokens, bad in rows if set(rule) <= set(tokens)]
            if sum(marks) >= 5 and sum(marks) / len(marks) >= 0.4:
                share[rule] = sum(marks) / len(marks)
    want = {r: c for r, c in share.items() if not any(set(o) < set(r) and d >= c for o, d in share.items())}
    found = urls.mined_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_confidence=0.4).collect()
    assert {tuple(r["rule_tokens"]): pytest.approx(r["confidence"]) for r in found} == want and len(found) == len(want)
    assert max(map(len, want)) >= 3


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "src0", 0), (10_002, "12 34", "en", "src0", 5), (10_003, "Hello You", None, None, 9), (10_004, "hello you", None, None, 9)], docs.schema)
    docs = docs.unionAll(odd)
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        path = corpus_pipeline.stored(docs, "test-stage")
        steps[name] = before.collect(), path.collect()
        docs = path
    before, after = steps["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {10_001, 10_002}
    before, after = steps["exact_dedup"]
    keep = {}
    for r in before:
        text = (r["text"] or "").translate(UPPER)
        keep[text] = max(keep.get(text, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(keep.values())
    before, after = steps["near_dedup"]
    from test_jaccard import brute_force
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in brute_force([(r["doc_id"], r["text"]) for r in before])})
    before, after = steps["source_mix"]
    size = {r["doc_id"]: len(words(r["text"])) for r in before}
    taken = dict.fromkeys(size, 0)
    for r in after:
        taken[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert all(taken[i] <= 3 * n for i, n in size.items()) and abs(sum(taken.values()) - sum(size.values())) <= 16
    before, after = steps["byte_bpe"]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert sorted((r["doc_id"], r["n_tokens"]) for r in after) == sorted((r["doc_id"], len(own.encode_ordinary(r["text"]))) for r in before)


def test_pipeline_keeps_columns_named_like_added_ones(spark):
    rows = [(i, f"some words of text {i}" if i else "12 34", "en" if i % 2 else None, "src", 5, f"own {i}", i + 0.5, "s", "e", -i) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, shard string, epoch string, n_words long"
    docs = spark.createDataFrame(rows, schema)
    found = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert found.columns == docs.columns and sorted(map(tuple, found.collect()), key=lambda r: r[0]) == rows[1:]
    mix = corpus_pipeline.source_mix(spark, docs, FOLDER)
    assert mix.columns == docs.columns and {tuple(r)[5:] for r in mix.collect()} <= {r[5:] for r in rows}
    unlabelled = spark.createDataFrame([(i, t, None) for i, t in enumerate(["12 34", "words", None])], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, unlabelled, FOLDER).collect()] == [1]
