"""The source mix against highest quotients one by one and against water filling round by round."""

import re
from collections import defaultdict

import pytest

from palmares.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def highest_quotients(votes, most, house):
    """Seats one by one to the highest votes / (2 k + 1); ties to the earlier source."""
    seats = [0] * len(votes)
    for _ in range(house):
        i = max((i for i in range(len(votes)) if seats[i] < most[i]), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
        seats[i] += 1
    return seats


def water_fill(sizes, weights, cap=3):
    total, capped = sum(sizes), set()
    while True:
        free = sum(w for i, w in enumerate(weights) if i not in capped)
        left = total - sum(cap * sizes[i] for i in capped)
        target = [cap * s if i in capped else left * weights[i] / free for i, s in enumerate(sizes)]
        above = {i for i, s in enumerate(sizes) if i not in capped and target[i] > cap * s}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("sizes", [[100, 5000, 3, 800, 0, 70], [10, 10, 10, 10], [7], [1, 1, 100000, 1], [50] * 9])
def test_targets_and_quotas(spark, sizes):
    frame = spark.createDataFrame([(f"0s{i:02}", s) for i, s in enumerate(sizes)], "src string, source_size long")
    targets = mixing.source_targets(frame)
    found = {r["src"]: r["target"] for r in targets.collect()}
    want = water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [found[f"0s{i:02}"] for i in range(len(sizes))] == pytest.approx(want)
    for block, shards in ((1, 1), (4, 3), (16, 5)):
        cut = {(r["src"], r["shard"]): r["upto"] for r in mixing.quotas(targets, block, shards).collect()}
        most = [3 * s // block for s in sizes]
        house = min(round(sum(sizes) / block), sum(most))
        for shard in range(shards):
            got = [cut[f"0s{i:02}", shard] for i in range(len(sizes))]
            votes = [found[f"0s{i:02}"] for i in range(len(sizes))]
            assert got == highest_quotients(votes, most, house * (shard + 1) // shards)


def documents(spark):
    rows = []
    for i in range(400):
        source = None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}"
        text = None if i % 17 == 0 else "" if i % 19 == 0 else " \t".join(f"w{i}_{k}" for k in range(i % 50))
        rows.append((i, text, source, "clash", 1))
    rows += [(500, "x " * 20_000, "s1", None, None), (3, "again", "hot", None, None), (3, "again", "hot", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_shares_come_near_their_targets(spark):
    docs = documents(spark)
    rows = mixing.shares(docs, ["doc_id", "text", "source", "size"], bucket_rows=50).collect()
    assert len(rows) == docs.count()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"], r["source_size"]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for source, aim in zip(order, want):
        assert target[source] == (pytest.approx(aim), sizes[source])
        assert abs(taken[source] - aim) <= len(order) * mixing.BLOCK


def test_reruns_agree(spark):
    docs = documents(spark)
    once = lambda d: sorted((r["doc_id"], r["size"], r["taken"]) for r in mixing.shares(d, ["doc_id"], bucket_rows=50).collect())
    assert once(docs) == once(docs.repartition(7))


def test_mix_holds_the_words_that_the_shares_count(spark):
    docs = documents(spark).withColumnRenamed("size", "n_words")
    shares = {}
    for r in mixing.shares(docs, ["doc_id", "text"], bucket_rows=50).collect():
        shares[r["doc_id"], r["text"]] = shares.get((r["doc_id"], r["text"]), 0) + r["taken"]
    mix = mixing.mixed(docs, shards=4, bucket_rows=50).collect()
    words, by_shard = defaultdict(int), defaultdict(int)
    for r in mix:
        assert len(WORD.findall(r["text"])) == r["n_words"] > 0
        words[r["doc_id"]] += r["n_words"]
        by_shard[r["shard"]] += r["n_words"]
    wanted = defaultdict(int)
    for (key, _), n in shares.items():
        wanted[key] += n
    assert {k: n for k, n in words.items()} == {k: n for k, n in wanted.items() if n}
    assert max(by_shard.values()) - min(by_shard.values()) <= mixing.BLOCK


def test_columns_and_lengths_of_the_mix(spark):
    docs = documents(spark)
    mix = mixing.mixed(docs, n_chars="target", shards=2)
    assert mix.columns[:5] == docs.columns
    assert all(r["target"] == len(r["text"]) for r in mix.collect())


def test_no_rows_and_no_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.shares(empty, ["doc_id"]).collect() == [] and mixing.mixed(empty).collect() == []
    silent = spark.createDataFrame([(1, None, "a", None, None), (2, " \n", None, None, None)], SCHEMA)
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in mixing.shares(silent, ["doc_id"]).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    assert mixing.mixed(silent).collect() == []
