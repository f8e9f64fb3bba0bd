"""The registered queries over whole tables against plain Python: every column, digests included."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_jaccard import brute_force
from tokenizers import Tokenizer

from palmares.llm import bpe, language, sharding
from palmares.llm.queries import QUERIES, RANKS

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(data):
    return sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


@pytest.fixture(scope="module")
def found(spark):
    return lambda name: QUERIES[name](spark, FOLDER).collect()


def test_op1_sizes_sums_and_even_gapless_shards(found, docs):
    rows = found("op1_external_shuffle")
    want = [(d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode()), "rows", None) for d in docs]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows) == sorted(want)
    shards = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(24)}
    assert sum(map(len, shards.values())) == len(rows) and all(slots == list(range(len(slots))) for slots in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_op1_order_owes_nothing_to_keys_sources_and_input_order(found, docs):
    """Places of a uniform shuffle: each shard's doc_ids have ranks about the mean of all, neighbours are no input neighbours."""
    rows = sorted(found("op1_external_shuffle"), key=lambda r: (r["shard"], r["slot"]))
    ids = [r["doc_id"] for r in rows]
    rank = {d: i for i, d in enumerate(sorted(ids))}
    n = len(ids)
    assert abs(np.corrcoef(range(n), [rank[d] for d in ids])[0, 1]) < 4 / math.sqrt(n)
    assert sum(abs(rank[a] - rank[b]) == 1 for a, b in zip(ids, ids[1:])) <= 12
    assert len(set(ids)) == n == len(docs)


def test_op2_removes_what_starts_elsewhere_too(found, docs):
    size, texts = 200, {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    often = Counter(t[i : i + size] for t in texts.values() for i in range(len(t) - size + 1))
    want = []
    for doc_id, text in texts.items():
        gone = np.zeros(len(text) + 1, np.int64)
        for i in range(len(text) - size + 1):
            if often[text[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        covered = np.cumsum(gone)[: len(text)] > 0
        starts = int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
        left = bytes(b for b, c in zip(text, covered) if not c)
        want.append((doc_id, len(text), int(covered.sum()), starts, digest(left)))
    rows = found("op2_repeated_substrings")
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == sorted(want)
    assert any(w[2] for w in want)


def test_op4_sizes_targets_and_words_taken(found, docs):
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    names = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    held = {s: sum(size[d["doc_id"]] for d in docs if d["source"] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(held.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * held[s]}
        if not full:
            break
        target.update({s: 3.0 * held[s] for s in full})
        rest -= sum(3 * held[s] for s in full)
        open_ -= full
    target.update(share)
    rows, source = found("op4_source_mix"), {d["doc_id"]: d["source"] for d in docs}
    assert sorted(r["doc_id"] for r in rows) == sorted(size)
    taken = Counter()
    for r in rows:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], held[source[r["doc_id"]]])
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 16 for s in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, found("op4_source_mix")))


def test_op5_equals_the_library(found, docs):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = []
    for d in docs:
        ids = own.encode_ordinary(d["text"] or "")
        want.append((d["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(own.decode_bytes(ids))))
    rows = found("op5_byte_bpe")
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(want)


def test_op11_equals_the_library(found, docs):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own.no_truncation()
    own.no_padding()
    want = []
    for d in docs:
        ids = own.encode(d["text"] or "", add_special_tokens=False).ids
        want.append((d["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(own.decode(ids, skip_special_tokens=False))))
    rows = found("op11_word_bpe")
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(want)


def plain_language(model, text):
    """The two steps by themselves: the family with the largest margin, then votes of its pairs. Exact sums, no arrays."""
    if not text or not language.LETTER.search(text):
        return "und", 0.0
    data = (" " + language.SEPARATORS.sub(" ", text.lower()) + " ").encode()
    grams = Counter(data[i : i + 3] for i in range(len(data) - 2))
    bits, feature = language.DIM.bit_length() - 1, Counter()
    for gram, n in grams.items():
        feature[(int.from_bytes(gram, "big") * 2654435761 % 2**32) >> (32 - bits)] += n
    total = sum(grams.values())
    margin = {
        task: math.fsum(float(w[place]) * math.sqrt(n / total) for place, n in feature.items()) + float(b)
        for task, w, b in zip(model.tasks, model.weights, model.bias)
    }
    of_family = [math.exp(language.SHARPNESS * margin.get(("family", g), 0.0)) for g in range(len(model.groups))]
    family = of_family.index(max(of_family))
    names = model.groups[family]
    sure = of_family[family] / sum(of_family)
    if len(names) == 1:
        return names[0], sure
    votes = Counter()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            p = 1 / (1 + math.exp(-language.SHARPNESS * margin["pair", a, b]))
            votes[a] += p
            votes[b] += 1 - p
    best = min(names, key=lambda name: (-votes[name], name))
    return best, sure * votes[best] / (len(names) - 1)


def test_op6_equals_the_two_steps(spark, found, docs):
    model = language.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert len(model.groups) > 1 and any(len(g) > 1 for g in model.groups)
    rows, text = found("op6_language_id"), {d["doc_id"]: d["text"] for d in docs}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        name, score = plain_language(model, text[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["lang_pred"] == name and r["score"] == pytest.approx(score, abs=1e-4) and 0 <= r["score"] <= 1


def test_language_id_on_very_long_texts_repeated_rows_and_no_rows(spark):
    model = language.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    texts = ["x" * 200_000, "the " * 60_000, "12 34", "", None, "ab", "ab", "\U0001f600é"]
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    rows = sorted(language.identified(frame, model).collect(), key=lambda r: r["doc_id"])
    assert [r["lang_pred"] == "und" for r in rows] == [False, False, True, True, True, False, False, False]
    assert rows[5]["lang_pred"] == rows[6]["lang_pred"] and rows[5]["score"] == rows[6]["score"]
    for r, text in zip(rows, texts):
        name, score = plain_language(model, text)
        assert r["lang_pred"] == name and r["score"] == pytest.approx(score, abs=1e-4)
    assert language.identified(frame.limit(0), model).collect() == []


def test_op7_equals_all_pairs(found, docs):
    want = brute_force([(d["doc_id"], d["text"]) for d in docs])
    rows = found("op7_jaccard_join")
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == sorted(want)


def test_op9_thresholds_decide(found, docs):
    rows = found("op9_kneser_ney")
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in docs)
    limit, text = {}, {d["doc_id"]: d["text"] or "" for d in docs}
    for r in rows:
        empty = not WORD.search(text[r["doc_id"]])
        assert (r["perplexity"] is None) == empty and r["kept"] == (not empty and (r["threshold"] is None or r["perplexity"] <= r["threshold"]))
        assert limit.setdefault(r["lang"], (r["threshold"], r["threshold_from"])) == (r["threshold"], r["threshold_from"])
    assert {source for _, source in limit.values()} <= {"unseen", "left_out", "none"}


def test_op10_recall_ranks_and_scores(spark, found):
    table = {r["vec_id"]: r for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    column = next(c for c, v in next(iter(table.values())).asDict().items() if isinstance(v, list))
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    vectors = {i: np.array(r[column], float) for i, r in table.items() if usable(r[column])}
    ids = sorted(vectors)
    assert len({len(v) for v in vectors.values()}) == 1
    every = np.array([vectors[i] for i in ids])
    given = {}
    for r in found("op10_rotated_codes"):
        given.setdefault(r["query_id"], []).append(r)
    assert sorted(given) == [i for i in ids if i % 20 == 0]
    met = wanted = 0
    for query, rows in given.items():
        scores = dict(zip(ids, (every @ vectors[query]).tolist()))
        del scores[query]
        best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(best) + 1))
        assert [r["score"] for r in rows] == pytest.approx([scores[r["vec_id"]] for r in rows], rel=1e-12, abs=1e-12)
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(rows, rows[1:]))
        met, wanted = met + len({r["vec_id"] for r in rows} & set(best)), wanted + len(best)
    assert met >= 0.9 * wanted


def test_counts_of_few_rows_are_even(spark):
    frame = spark.createDataFrame([(i, f"text {i % 7}") for i in range(101)], "doc_id long, text string")
    rows = sharding.shards(frame).collect()
    shards = max(r["shard"] for r in rows) + 1
    even = [101 // shards + (s < 101 % shards) for s in range(shards)]
    assert sorted(Counter(r["shard"] for r in rows).values()) == sorted(even)
    assert {(r["doc_id"], r["text"]) for r in rows} == {(i, f"text {i % 7}") for i in range(101)}
