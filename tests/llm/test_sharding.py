"""The external shuffle: whole records, even shards, the same result again, uniform places."""

from collections import Counter, defaultdict

import numpy as np

from palmares.llm import sharding

SCHEMA = "doc_id long, text string, shard string, bucket double, tags array<string>"


def documents(spark, n=500):
    rows = [(i % 400, None if i % 7 == 0 else "ä" * (i % 31), "s", float(i % 3), ["x"] * (i % 2)) for i in range(n)]
    rows += [(None, "", None, None, None), (None, "", None, None, None), (9, "long " * 50_000, "t", 0.0, [])]
    return spark.createDataFrame(rows, SCHEMA)


def test_fisher_yates_is_a_uniform_permutation():
    assert sorted(sharding.fisher_yates(100, [1, 2]).tolist()) == list(range(100))
    assert sharding.fisher_yates(0, [1]).tolist() == [] and sharding.fisher_yates(1, [1]).tolist() == [0]
    seen = Counter(tuple(sharding.fisher_yates(3, [s]).tolist()) for s in range(6000))
    assert len(seen) == 6 and max(abs(n - 1000) for n in seen.values()) < 150


def test_all_records_once_in_even_gapless_shards(spark):
    docs = documents(spark)
    out = sharding.shards(docs, n_shards=7, bucket_bytes=4096)
    assert out.columns == ["doc_id", "text", "bucket", "tags", "shard", "slot"]
    rows = out.collect()
    plain = lambda r: (r["doc_id"], r["text"], r["bucket"], tuple(r["tags"]) if r["tags"] is not None else None)
    assert Counter(map(plain, rows)) == Counter(map(plain, docs.collect()))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_reruns_agree_whatever_the_partitions(spark):
    docs = documents(spark)
    place = lambda d: Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.shards(d, n_shards=5, bucket_bytes=8192).collect())
    assert place(docs) == place(docs.repartition(11))


def test_copies_of_one_record_spread_over_buckets(spark):
    assert sharding.external_shuffle(documents(spark, 9)).columns == ["doc_id", "text", "shard", "tags", "bucket", "position"]
    docs = spark.range(4000).selectExpr("CASE WHEN id < 3000 THEN 1 ELSE id END AS doc_id", "'text' AS text")
    out = sharding.external_shuffle(docs, bucket_bytes=1000, repeats=100)
    sizes = [r["n"] for r in out.groupBy("bucket").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()]
    assert sum(sizes) == 4000 and max(sizes) < 5 * np.mean(sizes)


def test_empty_table_and_few_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shards(empty).collect() == []
    one = sharding.shards(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["shard"], r["slot"]) for r in one] == [(1, 0, 0)]


def test_shards_are_written_as_folders(spark, tmp_path):
    sharding.write_shards(sharding.shards(documents(spark), n_shards=3), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]
