"""Boundary rows of bins, recodes, filters, imputation and encodings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palmares.functions.bins import age_bin, decade_bin, equal_width_bins, label_bounds
from palmares.functions.recode import agreement, flag, override, recode, unflag
from palmares.functions.scalar import century, cyclic, decorated, word
from palmares.operators.encode import first_seen_index, label_index, standardise
from palmares.operators.filters import apply_filters, expand_values, member
from palmares.operators.impute import fill_body_measures, fill_with_group_mean
from palmares.operators.joins import lookup
from palmares.operators.projection import insert_after
from palmares.operators.quality import covers, drop_report, missing_keys, null_profile
from palmares.operators.ranges import range_label
from palmares.sources.files import clean_lookup


def column(frame, name):
    return [row[name] for row in frame.collect()]


def test_age_bins_label_one_above_the_edge_and_drop_the_oldest(spark):
    ages = [0.0, 19.5, 20.0, 25.0, 30.0, 40.0, 59.0, 60.0, 97.0, 100.0, 120.0, -1.0, None]
    rows = spark.createDataFrame([(a,) for a in ages], "age double").select("age", age_bin("age").alias("bin"))
    expected = ["1-20", "1-20", "21-25", "26-30", "31-40", "41-60", "41-60", None, None, None, None, None, None]
    assert column(rows, "bin") == expected


def test_decade_bins_are_closed_on_the_right(spark):
    ages = [0.0, 20.0, 20.5, 30.0, 31.0, 100.0, 101.0, None]
    rows = spark.createDataFrame([(a,) for a in ages], "age double").select(decade_bin("age").alias("bin"))
    assert column(rows, "bin") == [None, "1-20", "21-30", "21-30", "31-40", "91-100", None, None]


def test_equal_width_bins_label_seven_of_eight(spark):
    values = [18.5, 20.55, 20.56, 20.57, 22.61, 22.62, 24.0, 28.77, 30.83, 32.88, 32.89, 34.9, 34.94]
    edges = [float(np.round(e, 2)) for e in np.linspace(min(values), max(values), 9)]
    expected = {None: None}
    for value in values:
        i = max(i for i in range(8) if value >= edges[i])
        start = edges[0] if i == 0 else float(np.round(edges[i] + 0.01, 2))
        expected[value] = f"{start}-{edges[i + 1]}" if i < 7 else None
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "bmi double")
    assert {r["bmi"]: r["bin"] for r in equal_width_bins(rows, "bmi", "bin", drop=False).collect()} == expected
    assert equal_width_bins(rows, "bmi", "bin").count() == sum(v is not None for v in expected.values())


def test_equal_width_bins_of_one_value(spark):
    rows = spark.createDataFrame([(21.0,), (21.0,), (None,)], "bmi double")
    assert column(equal_width_bins(rows, "bmi", "bin"), "bin") == ["21.0-21.0"] * 2
    assert equal_width_bins(rows.filter("bmi > 50"), "bmi", "bin").count() == 0


def test_recodes(spark):
    rows = spark.createDataFrame([("F",), ("M",), ("X",), (None,)], "v string")
    names = {"F": "Female", "M": "Male"}
    assert column(rows.select(recode("v", names).alias("v")), "v") == ["Female", "Male", "X", None]
    assert column(rows.select(recode("v", names, default=None, null_as="?").alias("v")), "v") == ["Female", "Male", None, "?"]
    moved = spark.createDataFrame([("RUS", "Europe"), ("POL", "Europe")], "noc string, c string")
    assert column(moved.select(override("c", "noc", "RUS", "Asia").alias("c")), "c") == ["Asia", "Europe"]


def test_flags(spark):
    rows = spark.createDataFrame([("No medal", 0), ("Gold", 0), ("Silver", 1)], "medal string, predicted int")
    rows = rows.withColumn("actual", flag("medal", "No medal"))
    assert column(rows, "actual") == [0, 1, 1]
    assert column(rows.select(unflag("actual", "Medal", "No medal").alias("n")), "n") == ["No medal", "Medal", "Medal"]
    tags = column(rows.select(agreement("actual", "predicted").alias("t")), "t")
    assert tags == ["right negative", "wrong positive", "right positive"]


def test_words_and_labels(spark):
    rows = spark.createDataFrame([("1992 Summer",), ("1992",), (None,)], "games string")
    assert column(rows.select(word("games", 1).alias("w")), "w") == ["Summer", None, None]
    labels = spark.createDataFrame([("21-25",), ("Unknown",)], "label string")
    lo, hi = label_bounds(F.col("label"))
    assert [tuple(r) for r in labels.select(lo, hi).collect()] == [(21, 25), (None, None)]
    pair = spark.createDataFrame([("21-25", "Male")], "a string, b string")
    assert column(pair.select(decorated(F.col("a"), F.col("b")).alias("l")), "l") == ["21-25 (Male)"]


def test_century_and_cycle(spark):
    rows = spark.createDataFrame([(1800,), (1801,), (1900,), (1901,), (2000,), (2001,), (2100,), (2101,), (None,)], "y int")
    assert column(rows.select(century("y").alias("c")), "c") == [None, 19, 19, 20, 20, 21, 21, None, None]
    sine, cosine = cyclic("y", F.lit(2000))
    row = rows.filter("y = 2000").select(sine.alias("s"), cosine.alias("c")).first()
    assert row["s"] == pytest.approx(0, abs=1e-12) and row["c"] == pytest.approx(1)


def test_empty_choice_means_default(spark):
    rows = spark.createDataFrame([("Male", 2), ("Female", 3), ("Other", 2)], "sex string, golds bigint")
    defaults = {"sex": ["Male", "Female"]}
    assert apply_filters(rows, {"sex": []}, defaults).count() == 2
    assert apply_filters(rows, {}, defaults).count() == 2
    assert apply_filters(rows, {"sex": [], "golds": []}).count() == 3
    assert apply_filters(rows, {"golds": [2]}).count() == 2
    assert apply_filters(rows, {"golds": ["2", "Male"], "sex": ["2", "Male"]}).count() == 1
    assert rows.filter(member("golds", ["Male", "3"])).count() == 1


def test_expansion_adds_predecessors_once():
    assert expand_values(["GER", "POL", "FRG"]) == ["GER", "POL", "FRG", "GDR"]
    assert expand_values(["POL"]) == ["POL"]


def test_three_stage_imputation(spark):
    rows = spark.createDataFrame(
        [
            ("run", 180.0, 70.0), ("run", 180.0, None), ("run", 170.0, 60.0), ("run", None, None),
            ("run", None, 80.0), ("run", 160.0, None), ("swim", None, 90.0), ("swim", None, None), ("row", 190.0, None),
        ],
        "sport string, height double, weight double",
    )
    filled = sorted((r["sport"], r["height"], r["weight"]) for r in fill_body_measures(rows).collect())
    mean_height = (180 + 180 + 170 + 160) / 4
    # Weights after the second step: 70, 70, 60, 80 (mean height has one known weight), 80; their mean fills the last.
    assert filled == sorted([
        ("run", 180.0, 70.0), ("run", 180.0, 70.0), ("run", 170.0, 60.0), ("run", mean_height, 80.0),
        ("run", mean_height, 80.0), ("run", 160.0, 72.0),
    ])
    assert fill_body_measures(rows, drop=False).count() == 9


def test_group_mean_fill_keeps_known_values(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None)], "k string, v double")
    assert sorted(map(str, column(fill_with_group_mean(rows, ["v"], "k"), "v"))) == ["1.0", "2.0", "3.0", "None"]


def test_lookup_defaults_and_blank_keys(spark):
    codes = spark.createDataFrame(
        [("POL", "EU"), ("USA", "NA"), ("", "AF"), ("\u00a0", "AN"), (None, "AS"), ("XXX", None), (" FRA ", "EU")],
        "ioc string, continent string",
    )
    cleaned = clean_lookup(codes)
    assert {tuple(r) for r in cleaned.collect()} == {("POL", "EU"), ("USA", "NA"), ("XXX", "NA"), ("FRA", "EU")}
    rows = spark.createDataFrame([("POL",), ("???",), ("\u00a0",), (None,)], "noc string")
    assert sorted(column(lookup(rows, "noc", cleaned, "ioc", "continent", "c", "NA"), "c")) == ["EU", "NA", "NA", "NA"]
    assert {tuple(r) for r in missing_keys(rows, "noc", cleaned, "ioc").collect()} == {("???", 1), ("\u00a0", 1), (None, 1)}
    assert tuple(covers(rows.filter("noc = 'POL'"), "noc", cleaned, "ioc").first()) == (1, 0, True)


def test_range_label_is_inclusive_and_floors(spark):
    labels = spark.createDataFrame([("1-20",), ("21-25",), ("21-30",), ("x",)], "age_bin string")
    rows = spark.createDataFrame([(20.4,), (20.99,), (21.0,), (25.9,), (31.0,), (None,)], "mean double")
    labelled = {r["mean"]: r["label"] for r in range_label(rows, "mean", labels, "age_bin", "label").collect()}
    assert labelled[20.4] == labelled[20.99] == "1-20" and labelled[21.0] in ("21-25", "21-30")
    assert labelled[31.0] is None and labelled[None] is None


def test_profiles_and_reports(spark):
    rows = spark.createDataFrame([("a", None), (None, 1), ("b", 2)], "x string, y int")
    profile = {r["column"]: (r["n_null"], r["n_not_null"], round(r["pct_null"], 2)) for r in null_profile(rows, ["x", "y"]).collect()}
    assert profile == {"x": (1, 2, 33.33), "y": (1, 2, 33.33)}
    assert tuple(drop_report(rows, ["x", "y"]).first()) == (3, 1, 2)
    assert null_profile(rows.filter("false"), ["x"]).first()["pct_null"] is None


def test_encodings(spark):
    rows = spark.createDataFrame([("run", 3), ("box", 1), ("run", 2), (None, 9), ("swim", 1)], "s string, at int")
    assert {(r["s"], r["i"]) for r in label_index(rows, {"s": "i"}).collect()} == {("box", 0), ("run", 1), ("swim", 2), (None, None)}
    seen = first_seen_index(rows.filter("s is not null"), {"s": "i"}, ["at"])
    assert {(r["s"], r["i"]) for r in seen.collect()} == {("box", 0), ("swim", 1), ("run", 2)}
    z = [r["v_z"] for r in standardise(spark.createDataFrame([(1.0,), (3.0,)], "v double"), ["v"]).collect()]
    assert sorted(z) == [-1.0, 1.0]
    assert column(standardise(spark.createDataFrame([(5.0,)], "v double"), ["v"]), "v_z") == [0.0]


def test_insert_after(spark):
    rows = spark.createDataFrame([(1, 2)], "a int, b int")
    assert insert_after(rows, "a", "c", F.lit(0)).columns == ["a", "c", "b"]
