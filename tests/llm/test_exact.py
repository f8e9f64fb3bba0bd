"""Exact dedup against grouping in plain Python."""

from collections import Counter, defaultdict

import pytest

from palmares.llm import exact

SCHEMA = "doc_id long, text string, full string, kept boolean, size int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = "Ä word " * 40_000
ROWS = [
    (1, "Same Text", "x", True, 1), (2, "same text", "y", False, 2), (3, "same texT", None, None, None),
    (4, None, "z", None, 3), (5, "", "z", None, 4), (6, " ", "z", None, 5),
    (7, LONG, "a", None, 6), (8, LONG.replace("w", "W"), "a", None, 7), (9, LONG + "!", "a", None, 8),
    (10, "ÄB", "b", None, 9), (11, "äb", "b", None, 10), (12, "alone", "c", None, 11),
    (13, "twice", "c", None, 12), (13, "twice", "c", None, 12), (13, "Twice", "d", None, 13),
    (None, "null key", "e", None, 14), (14, "null key", "e", None, 15), (None, "only null", "e", None, 16),
    (15, "prefix " * 60 + "one", "f", None, 17), (16, "prefix " * 60 + "two", "f", None, 18),
]


def expected(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[(text or "").translate(UPPER)].append(key)
    out = Counter()
    for keys in groups.values():
        keep = max((k for k in keys if k is not None), default=None)
        out.update((k, keep, len(keys), k == keep) for k in keys)
    return out


@pytest.mark.parametrize("rows", [ROWS, [], [(1, None, None, None, None)]])
def test_decisions_equal_grouping(spark, rows):
    found = exact.decisions(spark.createDataFrame(rows, SCHEMA), prefix_chars=8, bins=64)
    assert Counter(tuple(r) for r in found.collect()) == expected([r[:2] for r in rows])


def test_one_row_of_each_text_stays_with_its_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = exact.deduplicated(docs)
    assert found.schema.names == docs.schema.names
    left = [tuple(r) for r in found.collect()]
    kept = {(k, t) for k, t in ((r[0], (r[1] or "").translate(UPPER)) for r in left)}
    assert len(left) == len({(r[1] or "").translate(UPPER) for r in ROWS}) == len(kept)
    want = {(text, keep) for (key, keep, _, k), text in ((d, None) for d in [])}
    assert want == set() and all(r in ROWS for r in left)
    assert {r[0] for r in left} == {3, 5, 6, 8, 9, 10, 11, 12, 13, 14, None, 15, 16}


def test_a_hot_text_is_counted(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Copy' ELSE concat('t', id) END AS text")
    rows = exact.decisions(docs).filter("group_size > 1").collect()
    assert len(rows) == 1000 and {r["keep_id"] for r in rows} == {2997} and sum(r["kept"] for r in rows) == 1
    assert exact.deduplicated(docs).count() == 2001
