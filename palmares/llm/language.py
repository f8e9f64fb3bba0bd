"""Language identification in two steps: the family of languages, then the language within it.

Families are found from the training texts: languages whose mean n-gram frequencies are most alike are merged until
there are about the square root of their number. One linear support vector machine tells each family from the others;
within a family one machine for each pair of languages decides (one versus one). Features are frequencies of hashed byte
trigrams of the lower-cased text; the fit holds only those that a text has. The machines are fitted on a bounded sample
of labelled rows; every whole text is predicted in the scan that reads it, with the weights as the only thing sent to the
tasks (bounded by the languages).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palmares.llm.common import gives_back, let_go
from palmares.store import stored

DIM = 1 << 13
#: Labelled rows of each language that the machines are fitted on, about.
SAMPLE = 400
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
SEPARATORS = regex.compile(r"[^\p{L}\p{M}']+")
SHARPNESS = 4.0


def counts(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased letters of a whole text, words apart, as shares of all trigrams."""
    data = np.frombuffer((" " + SEPARATORS.sub(" ", text.lower()) + " ").encode(), np.uint8).astype(np.uint32)
    grams = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    places = (grams * np.uint32(2654435761)) >> np.uint32(32 - DIM.bit_length() + 1)
    return np.bincount(places, minlength=DIM) / max(len(places), 1)


#: A packed vector has one such record for each share above zero, in the order of places. Its bytes sort like those of the
#: whole vector: an earlier place makes a larger vector.
RECORD = np.dtype([("before_end", ">u2"), ("share", "<f4")])


def pack(vector: np.ndarray) -> bytes:
    """The shares above zero of a vector, some hundreds of its ``DIM`` for a usual text."""
    at = np.flatnonzero(vector)
    out = np.empty(len(at), RECORD)
    out["before_end"], out["share"] = DIM - at, vector[at]
    return out.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places and shares of a packed vector."""
    records = np.frombuffer(data, RECORD)
    return DIM - records["before_end"].astype(np.int32), records["share"].astype(float)


def mean_profile(vectors: Sequence[bytes]) -> np.ndarray:
    """The mean of packed vectors."""
    total = np.zeros(DIM)
    for at, share in map(unpack, vectors):
        total[at] += share
    return total / max(len(vectors), 1)


def support_vector_machine(x: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 10.0, epochs: int = 30, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by dual coordinate descent; ``y`` holds -1 and 1, and
    each row of ``x`` its places and values other than zero."""
    weight, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(x))
    square = np.array([value @ value for _, value in x]) + 1 + 1 / (2 * cost)
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(x)):
            at, value = x[i]
            slope = y[i] * (value @ weight[at] + bias) - 1 + alpha[i] / (2 * cost)
            step = max(alpha[i] - slope / square[i], 0.0)
            change = (step - alpha[i]) * y[i]
            weight[at] += change * value
            bias += change
            alpha[i] = step
    return weight, float(bias)


def machine(rows: pd.DataFrame) -> pd.DataFrame:
    """(task, weight, bias) of the machine of one task, from its rows (task, lang, vector, side)."""
    rows = rows.sort_values(["lang", "vector"])
    x = [(at, np.sqrt(share)) for at, share in map(unpack, rows["vector"])]
    weight, bias = support_vector_machine(x, rows["side"].to_numpy())
    return pd.DataFrame({"task": [rows["task"].iloc[0]], "weight": [weight.astype(np.float32).tobytes()], "bias": [bias]})


def families(profiles: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages merged by the cosine of their mean profiles (average link) into about the square root of their number."""
    groups = [[name] for name in sorted(profiles)]
    unit = {name: p / max(np.linalg.norm(p), 1e-12) for name, p in profiles.items()}
    alike = lambda a, b: np.mean([unit[x] @ unit[y] for x in a for y in b])
    while len(groups) > isqrt(max(len(profiles) - 1, 0)) + 1:
        i, j = max(combinations(range(len(groups)), 2), key=lambda ij: alike(groups[ij[0]], groups[ij[1]]))
        groups[i] += groups.pop(j)
    return [sorted(g) for g in groups]


def scaled(x: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.sqrt(x) / spread


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.encode(F.col(f"`{key}`").cast("string"), "UTF-8")), F.lit(3)) == 1


class Hierarchy:
    """The fitted machines: one row of weights for each family and for each pair of languages within a family."""

    def __init__(self, groups: list[list[str]], machines: dict[tuple, tuple[np.ndarray, float]]):
        self.groups = groups
        self.tasks = list(machines)
        self.weights = np.array([machines[t][0] for t in self.tasks], np.float32).reshape(len(self.tasks), DIM)
        self.bias = np.array([machines[t][1] for t in self.tasks])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.groups or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        margins = dict(zip(self.tasks, self.weights @ np.sqrt(counts(text)).astype(np.float32) + self.bias))
        odds = np.exp(SHARPNESS * np.clip([margins.get(("family", g), 0.0) for g in range(len(self.groups))], -20, 20))
        share = odds / odds.sum()
        family = int(np.argmax(odds))
        names = self.groups[family]
        if len(names) == 1:
            return names[0], float(share[family])
        votes = dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            p = 1 / (1 + np.exp(-SHARPNESS * np.clip(margins["pair", a, b], -20, 20)))
            votes[a] += p
            votes[b] += 1 - p
        best = max(sorted(votes), key=votes.get)
        return best, float(share[family] * votes[best] / (len(names) - 1))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Hierarchy:
    """Machines fitted on about ``sample`` rows of each language, chosen by a hash of the key among the labelled rows
    that are not held out and have letters. Each machine is one small group of its own; only weights come back."""
    labelled = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.coalesce(~held_out("key"), F.lit(False))
    )
    amounts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    share = F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(1 << 30)) * F.col("rows") < F.lit(sample << 30)
    chosen = labelled.join(F.broadcast(stored(amounts, "lang-amounts")), "lang").filter(share).select("lang", "text")

    @gives_back
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                values = [pack(counts(t.as_py()).astype(np.float32)) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.binary())], names=["lang", "vector"])

    examples = stored(chosen.mapInArrow(vectors, "lang string, vector binary"), "lang-examples")
    profile = examples.groupBy("lang").applyInPandas(
        lambda key, rows: pd.DataFrame({"lang": [key[0]], "profile": [mean_profile(rows["vector"]).astype(np.float32).tobytes()]}),
        "lang string, profile binary",
    )
    groups = families({r["lang"]: np.frombuffer(r["profile"], np.float32) for r in profile.collect()})
    tasks = [(("family", g), dict.fromkeys(names, 1.0)) for g, names in enumerate(groups) if len(groups) > 1]
    tasks += [(("pair", a, b), {a: 1.0, b: -1.0}) for names in groups for a, b in combinations(names, 2)]
    if not tasks:
        return Hierarchy(groups, {})
    spark = docs.sparkSession
    everyone = [name for names in groups for name in names]
    sides = [(i, name, side.get(name, -1.0)) for i, (task, side) in enumerate(tasks) for name in (everyone if task[0] == "family" else side)]
    roles = spark.createDataFrame(sides, "task int, lang string, side double")

    fitted = examples.join(F.broadcast(roles), "lang").groupBy("task").applyInPandas(machine, "task int, weight binary, bias double")
    return Hierarchy(groups, {tasks[r["task"]][0]: (np.frombuffer(r["weight"], np.float32), r["bias"]) for r in fitted.collect()})


def identified(docs: DataFrame, model: Hierarchy, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language of every whole text and its score; ``und`` and 0 for null texts and texts
    without a letter, and for all texts if nothing was learned."""
    others = [c for c in docs.columns if c not in (prediction, score)]
    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    kind = T.StructType([*kept.schema.fields, T.StructField(prediction, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = others.index(text)

    @gives_back
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        fitted = shared.value
        for batch in batches:
            found = [fitted.predict(t.as_py()) for t in batch.column(at)]
            added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*others, prediction, score])

    return kept.mapInArrow(predict, kind)
