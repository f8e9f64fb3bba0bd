"""What a Python worker holds: the fit of a language machine in proportion to the trigrams, one vocabulary for all jobs."""

import re
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from palmares.llm import bpe, common, jaccard, language
from palmares.store import narrow_batches


def dense_machine(x, y, cost=10.0, epochs=30, seed=3):
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square, draw = (x * x).sum(axis=1) + 1 / (2 * cost), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(x)):
            step = max(alpha[i] - (y[i] * (x[i] @ weight) - 1 + alpha[i] / (2 * cost)) / square[i], 0.0)
            weight += (step - alpha[i]) * y[i] * x[i]
            alpha[i] = step
    return weight[:-1], float(weight[-1])


def examples(n, length):
    draw = np.random.default_rng(5)
    texts = ["".join(draw.choice(list("abcdefgh ijkl"[: 7 + 6 * (i % 2)]), length)) for i in range(n)]
    return [language.counts(t).astype(np.float32) for t in texts]


def test_a_machine_of_packed_vectors_is_that_of_whole_ones_in_their_order():
    whole = [*examples(40, 200), language.counts("").astype(np.float32), np.full(language.DIM, 0.5, np.float32)]
    packed = [language.pack(v) for v in whole]
    assert sorted(range(len(whole)), key=lambda i: packed[i]) == sorted(range(len(whole)), key=lambda i: whole[i].tobytes())
    assert np.allclose(language.mean_profile(packed), np.stack(whole).astype(float).mean(axis=0), rtol=0, atol=1e-12)
    side = np.where(np.arange(len(whole)) % 2, 1.0, -1.0)
    found = language.machine(pd.DataFrame({"task": 7, "lang": "x", "vector": packed, "side": side}))
    order = sorted(range(len(whole)), key=lambda i: packed[i])
    weight, bias = dense_machine(np.sqrt(np.stack([whole[i] for i in order]).astype(float)), side[order])
    assert np.allclose(np.frombuffer(found["weight"][0], np.float32), weight, atol=1e-6) and abs(found["bias"][0] - bias) < 1e-9


def test_the_fit_of_a_machine_stays_small():
    packed = [language.pack(v) for v in examples(100, 300)] * 24
    rows = pd.DataFrame({"task": 0, "lang": "x", "vector": packed, "side": np.where(np.arange(len(packed)) % 2, 1.0, -1.0)})
    tracemalloc.start()
    language.machine(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Whole vectors of doubles would take 157 MB for each copy.
    assert peak < 40e6


def test_a_worker_keeps_one_vocabulary_for_all_broadcasts():
    class Sent:
        value = {bytes([b]): b for b in range(256)}

    one = bpe._merges(bpe._Shared("a", Sent()), ".")
    assert bpe._merges(bpe._Shared("a", Sent()), ".") is one
    assert bpe._merges(bpe._Shared("b", Sent()), ".") is not one
    assert bpe._merges.cache_info().currsize == 1


def test_a_vocabulary_goes_when_another_operator_takes_the_worker():
    class Sent:
        value = {bytes([b]): b for b in range(256)}

    one = bpe._merges(bpe._Shared("a", Sent()), ".")
    common.let_go()
    assert bpe._merges.cache_info().currsize == 0
    assert bpe._merges(bpe._Shared("a", Sent()), ".") is not one


def test_texts_become_objects_a_slice_at_a_time():
    texts = ["a" * 5, None, "ß" * 3, "", "x" * 50, "yy"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["key", "text"])
    found = [(part.column(0).to_pylist(), cut) for part, cut in common.slices(batch, batch.column(1), 11)]
    assert found == [([0, 1, 2, 3], texts[:4]), ([4], texts[4:5]), ([5], texts[5:])]
    assert list(common.slices(batch.slice(0, 0), batch.column(1).slice(0, 0))) == []


def test_shared_shingles_are_counted_in_little_more_than_the_sets():
    draw = np.random.default_rng(5)
    common_ones = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common_ones[: i % 100], draw.integers(1 << 40, 1 << 62, 2_000, dtype=np.uint64)])) for i in range(1_000)]
    tokens, n = np.unique(np.concatenate(sets), return_counts=True)
    size = sum(s.nbytes for s in sets)
    tracemalloc.start()
    found = jaccard.several(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found[0] == tokens[n > 1]).all() and (found[1] == n[n > 1]).all() and not sets
    # The counts of all shingles would take another 2.5 times their size.
    assert peak < 1.4 * size
    assert all(len(x) == 0 for x in jaccard.several([]))


def held_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_a_task_over_texts_gives_its_memory_back():
    last = []

    def task(batches):
        for batch in batches:
            held = [np.ones(4_000) for _ in range(5_000)]
            last.append(held[-1])  # what lies behind freed memory keeps it from being returned
            yield batch

    common.give_back()
    before = held_mb()
    list(task(range(2)))
    left = held_mb() - before
    assert list(common.gives_back(task)(range(3))) == [0, 1, 2]
    assert left > 100 and held_mb() - before < 40


def test_the_last_stage_takes_texts_in_narrow_batches(spark, monkeypatch):
    def sizes(docs, *_, **__):
        def count(batches):
            for batch in batches:
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[0] * rows] * rows, pa.list_(pa.int32())), pa.array([b""] * rows)], names=["doc_id", "ids", "decoded"])

        return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, ids array<int>, decoded binary")

    monkeypatch.setattr(corpus_pipeline.bpe, "encode", sizes)
    docs = spark.range(0, 3_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1_000).alias("text"))
    option = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(option)
    found = corpus_pipeline.byte_bpe(spark, docs, "unused").agg(F.max("n_tokens"), F.count(F.lit(1))).first()
    assert found[0] < 1_000 and found[1] == 3_000 and spark.conf.get(option) == before
    spark.conf.set(option, 12_345_678)
    try:
        with narrow_batches(spark):
            assert spark.conf.get(option) == "12345678"
    finally:
        spark.conf.unset(option)
