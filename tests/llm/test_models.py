"""Language ID, Kneser-Ney quality and nearest neighbours against held-out rows, plain Python and brute force."""

import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from palmares.llm import kneser_ney, language, nearest

FOLDER = "/root/testdata/sf0.001"


def test_held_out_documents_are_recognised(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "12 !! 34", "en"), (None, "the and of", None)], "doc_id long, text string, lang string")
    docs = docs.select("doc_id", "text", "lang").unionAll(extra)
    model = language.fit(docs)
    assert sorted(x for g in model.groups for x in g) == ["de", "en", "es", "fr"] and len(model.groups) == 2
    rows = language.identified(docs.withColumn("score", F.lit("clash")), model).withColumn("held", language.held_out()).collect()
    held = [r for r in rows if r["held"] and r["doc_id"] >= 0]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (-1, -2, -3)} == {"und"}


def test_prediction_uses_the_text_alone(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    moved = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", -F.col("doc_id"))
    a = Counter((r["text"], r["lang_pred"], r["score"]) for r in language.identified(docs, model).collect())
    b = Counter((r["text"], r["lang_pred"], r["score"]) for r in language.identified(moved, model).collect())
    assert a == b


def test_nothing_to_learn_from(spark):
    for rows in ([], [(1, "text", None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert [r["lang_pred"] for r in language.identified(docs, language.fit(docs)).collect()] == ["und"] * len(rows)
    one = spark.createDataFrame([(i, f"some words {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identified(one, language.fit(one)).collect()} == {"en"}


def plain_kneser_ney(texts, order):
    """p(symbol | symbols before) by the textbook recursion over dictionaries."""
    levels = [Counter()]
    for text in texts:
        padded = "\x02" * (order - 1) + text + "\x03"
        levels[0].update(padded[i:i + order] for i in range(len(padded) - order + 1))
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    tables = []
    for counts in levels:
        n1, n2, n3, n4 = (sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        cut = lambda k, more, less: max(min(k - (k + 1) * y * more / less, k), 0.1) if less and n1 else 0.5
        d = [0, cut(1, n2, n1), cut(2, n3, n2), cut(3, n4, n3)]
        total, free, kinds = Counter(), Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            free[g[:-1]] += d[min(c, 3)]
            kinds[g[:-1]] += 1
        tables.append((counts, d, total, free, kinds))

    def p(gram, level):
        counts, d, total, free, kinds = tables[level]
        h = gram[:-1]
        if not h:
            return (max(counts[gram] - d[min(counts[gram], 3)], 0) + free[h] / (kinds[h] + 1)) / total[h]
        if not total[h]:
            return p(gram[1:], level + 1)
        return (max(counts[gram] - d[min(counts[gram], 3)], 0) + free[h] * p(gram[1:], level + 1)) / total[h]

    return lambda text: math.exp(-sum(
        math.log(p(q[i:i + order], 0)) for q in ["\x02" * (order - 1) + text + "\x03"] for i in range(len(q) - order + 1)
    ) / (len(text) + 1))


@pytest.mark.parametrize("shard_rows", [10**6, 40])
def test_perplexity_equals_the_recursion(spark, shard_rows):
    trusted = ["the cat sat on the mat", "the dog sat on the log", "ein hund saß", "the cats", "a mat"]
    others = ["the cat", "zzz ÄÖ \U0001f600", "x"]
    rows = [(i, t, "en", True) for i, t in enumerate(trusted)] + [(10 + i, t, "en", False) for i, t in enumerate(others)]
    rows += [(20, None, "en", False), (21, "", "en", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean")
    table = kneser_ney.model(docs.filter("good"), 3)
    found = {r["doc_id"]: r["perplexity"] for r in kneser_ney.scored(docs, table, 3, shard_rows=shard_rows).collect()}
    want = plain_kneser_ney(trusted, 3)
    for i, text, *_ in rows:
        assert found[i] == (pytest.approx(want(text), rel=1e-9) if text else None)


def test_words_in_unusual_order_are_less_likely(spark):
    trusted = ["The cat sat on the mat", "the dog sat on\tthe log", "a dog and a cat", "on the mat a dog sat", "the cat"]
    others = ["mat the on sat cat the", "the cat sat on the log", "the zebra", "\n"]
    rows = [(i, t, True) for i, t in enumerate(trusted)] + [(10 + i, t, False) for i, t in enumerate(others)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean").withColumn("lang", F.lit("en"))
    out = kneser_ney.scored(docs, kneser_ney.model(docs.filter("good"), 3, symbols=kneser_ney.WORDS), 3, symbols=kneser_ney.WORDS)
    found = {r["doc_id"]: (r["perplexity"], r["n_symbols"]) for r in out.collect()}
    letters = {}
    spelled = lambda text: "".join(letters.setdefault(w, chr(0x100 + len(letters))) for w in text.lower().split())
    want = plain_kneser_ney([spelled(t) for t in trusted], 3)
    for i, text, _ in rows:
        assert found[i] == ((pytest.approx(want(spelled(text)), rel=1e-9), len(text.split())) if text.strip() else (None, 0))
    assert found[10][0] > 1.5 * found[0][0]
    judged = kneser_ney.judged(docs, F.col("good"), ["doc_id"]).collect()
    assert {r["doc_id"]: r["n_symbols"] for r in judged} == {i: n for i, (_, n) in found.items()}


def test_scores_leave_the_model_where_it_is(spark, monkeypatch):
    """Neither the model nor the texts' n-grams are collected or broadcast by the module."""
    from pyspark import SparkContext
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*_):
        raise AssertionError("sent to or from the driver")

    docs = spark.createDataFrame([(i, f"the cat sat on mat {i % 5}", "en" if i % 2 else None) for i in range(30)], "doc_id long, text string, lang string")
    with monkeypatch.context() as patch:
        patch.setattr(SparkContext, "broadcast", refused)
        for name in ("toArrow", "collect", "toPandas", "toLocalIterator"):
            patch.setattr(DataFrame, name, refused)
        out = kneser_ney.scored(docs, kneser_ney.model(docs.filter("doc_id < 10"), 3), 3)
    found = out.collect()
    assert len(found) == 30 and len({(r["text"], r["lang"], r["perplexity"]) for r in found}) == 10


def test_thresholds_are_per_language_and_columns_stay(spark):
    base = [(i, f"common words of language {i % 3} again and again {i}", "a" if i % 2 else None, True, "clash") for i in range(80)]
    rows = base + [(100, "@@@@ #### $$$$ %%%%", "a", False, None), (101, "any text", "new", False, None), (102, None, "a", False, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean, kept string")
    out = kneser_ney.judged(docs, F.col("good"), ["doc_id", "lang", "kept"])
    assert out.columns == ["doc_id", "lang", "perplexity", "n_symbols", "threshold", "kept"]
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert not kept[100] and kept[101] and not kept[102] and sum(kept[i] for i in range(80)) > 70
    empty = kneser_ney.judged(docs.limit(0), F.col("good"))
    assert empty.collect() == []


def test_languages_with_few_trusted_texts_have_a_threshold(spark):
    draw = np.random.default_rng(3)
    usual = [" ".join(draw.choice(["the", "a", "cat", "dog", "sat", "on", "mat"], 60, p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.1, 0.05])) for _ in range(40)]
    draft = spark.createDataFrame([(t,) for t in usual], "text string")
    share = F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(kneser_ney.MEASURED)) == 0
    seen, unseen = ([r["text"] for r in draft.filter(want).limit(3).collect()] for want in (~share, share))
    junk = "@@@@ #### $$$$ %%%% &&&&"
    rows = [(lang, text, True) for lang, texts in ((None, seen), ("b", unseen), ("one", seen[:1])) for text in texts]
    rows += [(lang, junk, False) for lang in (None, "b", "one", "new")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string, good boolean")
    found = {r["doc_id"]: r for r in kneser_ney.judged(docs, F.col("good"), ["lang", "doc_id", "good"], source="from").collect()}
    for i, (lang, _, good) in enumerate(rows):
        judged = lang in (None, "b")
        assert found[i]["from"] == ("left_out" if judged else "none") and (found[i]["threshold"] is not None) == judged
        assert found[i]["kept"] == (good or not judged)


@pytest.mark.parametrize("order, crowded", [(1, None), (2, None), (3, 0.5), (4, 0.25)])
def test_any_order_and_crowded_pivots_equal_the_recursion(spark, monkeypatch, order, crowded):
    """Pivots that are dealt over several shards, symbols met in many pieces, and copies of texts change no result."""
    if crowded:
        monkeypatch.setattr(kneser_ney, "CROWDED", crowded)
        monkeypatch.setattr(kneser_ney, "LOOKED_AT", 1)
    monkeypatch.setattr(kneser_ney, "LOOKED_UP", 100)
    draw = np.random.default_rng(order)
    texts = ["".join(draw.choice(list("aaaabbcdefgh"), size)) for size in draw.integers(1, 60, 40)]
    trusted, others = texts[:30], [*texts[30:], texts[0], "zzz", "aaaaaaaaaaaaa"]
    rows = [(i, t, "en", i < 30) for i, t in enumerate([*trusted, *others, others[0]])]
    rows += [(i + 1000, t[::-1], "fr", good) for i, t, _, good in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean").repartition(3)
    table = kneser_ney.model(docs.filter("good"), order, most=50)
    found = {r["doc_id"]: r for r in kneser_ney.scored(docs, table, order, shard_rows=50, rounds=2).collect()}
    if crowded:
        assert table.pairs.filter(F.col("kind") == kneser_ney.PAIRS).select("shard").distinct().count() > 1
    want = {"en": plain_kneser_ney(trusted, order), "fr": plain_kneser_ney([t[::-1] for t in trusted], order)}
    for i, text, lang, _ in rows:
        assert (found[i]["perplexity"], found[i]["n_symbols"]) == (pytest.approx(want[lang](text), rel=1e-9), len(text))


def test_ngrams_are_summed_piece_by_piece(monkeypatch):
    monkeypatch.setattr(kneser_ney, "HELD_ROWS", 8)
    draw = np.random.default_rng(9)
    parts, want = [], Counter()
    for _ in range(20):
        symbols = np.unique(draw.integers(0, 40, 12).astype(np.uint64))
        rows = np.unique(draw.integers(0, len(symbols), (15, 3)), axis=0)
        n = draw.integers(1, 5, len(rows))
        parts.append(kneser_ney.Grams.read(kneser_ney.Grams(symbols, symbols % np.uint64(3), list(rows.T), [n]).pack(), 3))
        want.update({tuple(symbols[row].tolist()): int(k) for row, k in zip(rows, n, strict=True)})
    out = kneser_ney._summed(iter(parts))
    found = zip(*[out.symbols[c].tolist() for c in out.columns], strict=True)
    assert dict(zip(found, out.more[0].tolist(), strict=True)) == want and list(want) != sorted(want)
    assert (out.of == out.symbols % np.uint64(3)).all()


def test_disk_holds_few_bytes_a_word(spark, monkeypatch):
    """At any write the stored tables and the shuffle files of this write together take a few bytes a word."""
    held, peaks, stored = {}, [], kneser_ney.stored
    manager = spark._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        seen = manager.getAllFiles().iterator()
        out = {}
        while seen.hasNext():
            file = seen.next()
            if file.getName().startswith("shuffle_"):
                out[file.getName()] = file.length()
        return out

    def watched(*args, **more):
        before = files()
        out = stored(*args, **more)
        held[out.stored_path] = Path(out.stored_path.removeprefix("file:"))
        kept = sum(f.stat().st_size for path in held.values() for f in path.rglob("*.parquet"))
        peaks.append(kept + sum(size for name, size in files().items() if name not in before))
        return out

    monkeypatch.setattr(kneser_ney, "stored", watched)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("good", F.col("doc_id") % 3 == 0)
    words = docs.select(F.sum(F.size(F.split("text", r"\s+")))).head()[0]
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(option, "false")  # else the files of a write are gone when it returns
    try:
        kneser_ney.judged(docs, F.col("good"), ["doc_id"])
    finally:
        spark.conf.unset(option)
    assert max(peaks) < 12 * words, [round(p / words, 1) for p in peaks]
    peaks.clear()
    before = files()
    kneser_ney.judged(docs.limit(50), F.col("good"), ["doc_id"], rounds=2)
    assert peaks and sum(size for name, size in files().items() if name not in before) < 100_000


def brute_neighbours(rows, top, every):
    rows = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8]
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = defaultdict(list)
    for q, a in rows:
        if q % every == 0:
            near = sorted((-float(a @ b), i) for i, b in rows if i != q)[:top]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_neighbours_equal_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(size=8).astype(np.float32)]) for i in range(700)]
    common = rows[3][1]
    rows += [(i, common) for i in range(1000, 1200)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [1.0] * 7 + [None]), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (2100, [1.0]), (None, common)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, vector string, rank int")
    found = defaultdict(list)
    for r in nearest.search(frame, top=20, query_rows=16, code_rows=128).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_neighbours(rows, 20, 20)
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    for q in want:
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in want[q]])


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest.search(spark.createDataFrame([], schema)).collect() == []
    few = nearest.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], schema)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 1, 1.0), (0, 2, 3, -1.0)]


def test_double_vectors_and_equally_frequent_lengths(spark):
    draw = np.random.default_rng(3)
    vectors = [(i, draw.normal(size=6).tolist()) for i in range(60)]
    frame = spark.createDataFrame([*vectors, *[(100 + i, [1.0] * 7) for i in range(60)]], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest.search(frame, top=5, every=20).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    for q in (0, 20, 40):
        best = sorted(((i, product(vectors[q][1], v)) for i, v in vectors if i != q), key=lambda p: -p[1])[:5]
        assert [i for i, _ in found.pop(q)] == [i for i, _ in best]
    assert not found
