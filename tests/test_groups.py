"""Aggregates, histories, rankings, samples and metrics against brute force, with one key holding a third of the rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palmares.functions.scalar import salted_hash
from palmares.operators.aggregates import (
    category_pivot, distinct_levels, exact_distinct_levels, hierarchy, share, sketch_error, typical_category, with_root_share,
)
from palmares.operators.gaps import gap_label, row_lag, second_success, with_group_count, year_steps
from palmares.operators.metrics import binary_metrics, class_report
from palmares.operators.ranking import number_rows, one_per_key, top_k, top_k_per_group
from palmares.operators.sampling import exact_sample, exact_samples, split, time_folds
from palmares.operators.series import history_with_future, horizon, lag_features
from palmares.plans.doubles import achievement_series, age_at_first_gold, cohort, double_winners


@pytest.fixture(scope="module")
def history():
    """Rows (name, year): one name holds a third of them."""
    rng = random.Random(7)
    hot = [("hot", rng.choice(range(1990, 2012, 2))) for _ in range(1000)]
    rest = [(f"n{rng.randrange(700)}", rng.choice(range(1990, 2012, 2))) for _ in range(2000)]
    return hot + rest


def test_second_success_against_brute_force(spark, history):
    years = defaultdict(list)
    for name, year in history:
        years[name].append(year)
    expected = {}
    for name, ys in years.items():
        ys.sort()
        expected[name] = (ys[0], None if len(ys) < 2 else "S.Y." if ys[1] == ys[0] else str(ys[1] - ys[0]))
    rows = spark.createDataFrame(history, "name string, year int")
    found = second_success(rows, "name").select("name", "first_year", gap_label().alias("gap"))
    assert {r["name"]: (r["first_year"], r["gap"]) for r in found.collect()} == expected


def test_year_steps_hold_the_row_wise_lag(spark, history):
    expected = Counter()
    years = defaultdict(list)
    for name, year in history:
        years[name].append(year)
    for ys in years.values():
        ys.sort()
        expected.update(b - a for a, b in zip(ys, ys[1:]))
    found = Counter()
    for r in year_steps(spark.createDataFrame(history, "name string, year int"), "name").collect():
        found[0] += r["n"] - 1
        if r["gap"] is not None:
            found[r["gap"]] += 1
    assert +found == +expected


def test_row_lag_equals_a_window_and_splits_a_hot_key(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["hot"] * 9 + ["a", "b", None]), draw.choice([None, *range(40)]), i, draw.choice([None, 1.5, 2.5])) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, year int, i int, v double")
    out = row_lag(df, ["k"], ["year"], "v", "before", ["i"])
    assert out.columns == ["k", "year", "i", "v", "before"]
    want, last = {}, {}
    for k, year, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        want[i], last[k] = last.get(k), v
    assert {r["i"]: r["before"] for r in out.collect()} == want
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "lag(v" in line]
    assert windows and all("_range" in line for line in windows)
    assert row_lag(df.limit(0), ["k"], ["year"], "v", "before").collect() == []


def test_group_count_keeps_all_rows(spark, history):
    sizes = Counter(name for name, _ in history)
    rows = with_group_count(spark.createDataFrame(history, "name string, year int"), "name", "n").collect()
    assert len(rows) == len(history) and all(sizes[r["name"]] == r["n"] for r in rows)


def test_one_per_key_takes_the_smallest_row(spark, history):
    rows = [(name, year, i % 7) for i, (name, year) in enumerate(history)]
    expected = {name: min((y, t) for n, y, t in rows if n == name) for name in {n for n, _, _ in rows}}
    found = one_per_key(spark.createDataFrame(rows, "name string, year int, t int"), ["name"], ["year"]).collect()
    assert {r["name"]: (r["year"], r["t"]) for r in found} == expected and len(found) == len(expected)


def test_numbers_follow_the_order_of_the_whole_frame(spark, history):
    names = sorted({name for name, _ in history})
    rows = number_rows(spark.createDataFrame([(n,) for n in names], "name string").repartition(5), ["name"], "at")
    assert [r["name"] for r in sorted(rows.collect(), key=lambda r: r["at"])] == names
    assert sorted(r["at"] for r in rows.collect()) == list(range(len(names)))


def test_top_k_breaks_ties_by_name(spark):
    counts = spark.createDataFrame([("b", "s", 3), ("a", "s", 3), ("c", "s", 5), ("d", "w", 1), ("e", "w", 1)], "k string, g string, n int")
    assert [r["k"] for r in top_k(counts, 2, ties=["k"]).collect()] == ["c", "a"]
    ranked = {(r["g"], r["rank"]): r["k"] for r in top_k_per_group(counts, ["g"], 1, ties=["k"]).collect()}
    assert ranked == {("s", 1): "c", ("w", 1): "d"}


def test_typical_category_tie_order(spark):
    rows = spark.createDataFrame(
        [("gs", "Gold"), ("gs", "Silver"), ("sb", "Silver"), ("sb", "Bronze"), ("b", "Bronze"), ("none", "No medal")],
        "k string, medal string",
    )
    typical = {r["k"]: r["typical_medal"] for r in typical_category(rows, ["k"]).collect()}
    assert typical == {"gs": "Gold", "sb": "Silver", "b": "Bronze", "none": "Gold"}
    pivot = {r["k"]: (r["gold"], r["silver"], r["bronze"], r["total"]) for r in category_pivot(rows, ["k"]).collect()}
    assert pivot["gs"] == (1, 1, 0, 2) and pivot["none"] == (0, 0, 0, 0)


def test_united_sketches_are_within_their_error(spark):
    rows = spark.range(60000).select((F.col("id") % 7).alias("a"), (F.col("id") % 21).alias("b"), F.when(F.col("id") % 11 > 0, F.col("id") % 20011).alias("v"))
    exact = {(r["a"], r["b"], r["level"]): r["n"] for r in exact_distinct_levels(rows, ["a", "b"], "v").collect()}
    for lg in (14, 10):
        found = {(r["a"], r["b"], r["level"]): r["n"] for r in distinct_levels(rows, ["a", "b"], "v", lg=lg).collect()}
        assert found.keys() == exact.keys() and len(exact) == 1 + 7 + 21
        assert all(abs(found[k] - n) <= 4 * sketch_error(lg) * n for k, n in exact.items())
    assert exact[None, None, 0] == rows.select("v").distinct().count() - 1
    # Parts do not add up.
    assert sum(n for (_, _, level), n in exact.items() if level == 2) > exact[None, None, 0]


def test_hierarchy_levels_add_up(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "y", 3), ("b", "x", 5), ("a", "x", 1)], "p string, q string, v int")
    tree = hierarchy(rows, ["p", "q"], "v")
    found = {(r["p"], r["q"], r["level"]): r["amount"] for r in tree.collect()}
    assert found == {(None, None, 0): 11, ("a", None, 1): 6, ("b", None, 1): 5, ("a", "x", 2): 3, ("a", "y", 2): 3, ("b", "x", 2): 5}
    shares = {(r["p"], r["q"]): r["share"] for r in with_root_share(tree, ["p", "q"]).collect()}
    assert shares[("a", "x")] == 0.5 and shares[("b", None)] == 1.0
    assert sum(r["share"] for r in share(rows, "q", "v").collect()) == pytest.approx(1)


@pytest.mark.parametrize("bits, few", [(10, 1024), (3, 1), (7, 20)])
def test_exact_samples_are_the_first_by_hash(spark, bits, few):
    rows = spark.range(997).withColumn("k", F.col("id") * 3)
    order = sorted(rows.withColumn("h", salted_hash(["k"], 42)).collect(), key=lambda r: (r["h"] % (1 << 20), r["h"]))
    for pct, sample in exact_samples(rows, ["k"], (0, 1, 20, 60, 100), digit_bits=bits, few=few).items():
        assert sample.columns == ["id", "k"]
        assert sorted(r["id"] for r in sample.collect()) == sorted(r["id"] for r in order[: 997 * pct // 100])
    assert exact_sample(rows.limit(0), ["k"], 50).count() == 0


def test_exact_sample_of_keys_that_repeat(spark):
    rows = spark.range(3000).select(F.lit(7).alias("k"), "id")
    assert exact_sample(rows, ["k", "id"], 10, digit_bits=6, few=8).count() == 300
    assert exact_sample(rows, ["k"], 10, digit_bits=6, few=8).count() == 300


def test_split_is_complete_and_repeatable(spark):
    rows = spark.range(2000)
    parts = Counter(r["part"] for r in split(rows, ["id"], 80).collect())
    assert sum(parts.values()) == 2000 and 1500 < parts["train"] < 1700
    again = split(rows.repartition(3), ["id"], 80)
    assert again.exceptAll(split(rows, ["id"], 80)).count() == 0
    assert split(rows, ["id"], 80, seed=1).exceptAll(split(rows, ["id"], 80)).count() > 0


def test_folds_expand(spark):
    series = spark.createDataFrame([(y, 1) for y in range(2000, 2013)], "year int, v int")
    folds = defaultdict(lambda: defaultdict(list))
    for r in time_folds(series, "year").collect():
        folds[r["fold"]][r["role"]].append(r["year"] - 2000)
    for i, start in enumerate((3, 5, 7, 9, 11), 1):
        assert sorted(folds[i]["train"]) == list(range(start)) and sorted(folds[i]["test"]) == [start, start + 1]
    assert {(r["fold"], r["role"]) for r in time_folds(series.filter("year < 2005"), "year").collect()} == {(None, "too_short")}
    assert time_folds(series.filter("year < 2006"), "year").filter("role = 'test'").count() == 5


def test_series_helpers(spark):
    series = spark.createDataFrame([(2000, 1), (2002, 4), (2004, 9)], "year int, v int")
    rows = {r["year"]: (r["d1"], r["lag1"]) for r in lag_features(series, "year", "v", 1).collect()}
    assert rows == {2000: (None, None), 2002: (3, None), 2004: (5, 3)}
    both = history_with_future(series, horizon(series, "year", 2, 2)).collect()
    assert [(r["year"], r["v"], r["kind"]) for r in sorted(both, key=lambda r: r["year"])][3:] == [
        (2006, None, "forecast"), (2008, None, "forecast")
    ]


def test_metrics_against_hand_counts(spark):
    pairs = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 3
    rows = spark.createDataFrame(pairs, "actual int, predicted int")
    m = binary_metrics(rows, "actual", "predicted").first()
    assert (m["n"], m["accuracy"], m["precision"], m["recall"]) == (12, 9 / 12, 6 / 7, 6 / 8)
    report = {r["class"]: r for r in class_report(rows, "actual", "predicted").collect()}
    assert report["0"]["precision"] == 3 / 5 and report["0"]["recall"] == 3 / 4 and report["0"]["support"] == 4
    assert report["macro avg"]["recall"] == 0.75 and report["weighted avg"]["recall"] == pytest.approx(0.75)
    never = binary_metrics(spark.createDataFrame([(0, 0)], "actual int, predicted int"), "actual", "predicted").first()
    assert (never["precision"], never["recall"]) == (0.0, 0.0)


@pytest.fixture(scope="module")
def golds(spark):
    rows = [
        ("same year", "Male", "run", "Summer", "100", 22.0, "Europe", "POL", 2000, "Gold"),
        ("same year", "Male", "run", "Summer", "200", 22.0, "Europe", "POL", 2000, "Gold"),
        ("four", "Female", "box", "Summer", "a", 20.0, "Europe", "GER", 1996, "Gold"),
        ("four", "Female", "box", "Summer", "b", 24.0, "Europe", "GER", 2000, "Gold"),
        ("four", "Female", "box", "Summer", "b", 25.0, "Europe", "GER", 2000, "Gold"),
        ("four", "Female", "box", "Summer", "b", 28.0, "Europe", "GER", 2004, "Gold"),
        ("four", "Female", "box", "Summer", "b", 28.0, "Europe", "GER", 2004, "No medal"),
        ("once", "Male", "run", "Summer", "100", 22.0, "Europe", "POL", 2000, "Gold"),
        ("two sports", "Male", "run", "Summer", "100", 21.0, "Europe", "POL", 1996, "Gold"),
        ("two sports", "Male", "box", "Summer", "x", 25.0, "Europe", "POL", 2000, "Gold"),
        ("elsewhere", "Male", "run", "Summer", "100", 21.0, "Asia", "CHN", 1996, "Gold"),
        ("elsewhere", "Male", "run", "Summer", "100", 25.0, "Asia", "CHN", 2000, "Gold"),
    ]
    schema = "name string, sex string, sport string, season string, event string, age double, continent string, noc string, year int, medal string"
    return spark.createDataFrame(rows, schema)


def test_double_winners(spark, golds):
    rows = double_winners(golds).collect()
    assert Counter((r["name"], r["years_to_two"], r["gold_count"], r["unique_sports"]) for r in rows) == {
        ("same year", "S.Y.", 2, 1): 2, ("four", "4", 3, 1): 3,
    }
    first = {(r["age"], r["sex"], r["sport"]): r["n"] for r in age_at_first_gold(double_winners(golds)).collect()}
    assert first == {(22.0, "Male", "run"): 1, (20.0, "Female", "box"): 1}


def test_cohort_sums_totals_once_per_gold_row(spark, golds):
    rows = golds.withColumns({"height": F.lit(180.0), "weight": F.lit(75.0)})
    series = {r["year"]: r["y"] for r in achievement_series(cohort(rows)).collect()}
    # "four" has three golds under 26 and one other row: 4 per gold row; "same year" has two golds: 2 per gold row.
    assert series == {1996: 4, 2000: 4 + 4 + 2 + 2}
