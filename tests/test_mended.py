"""Ordinary CSV files, rows that must not vanish, and results that must not depend on the partitions."""

import random

from palmares.functions.bins import equal_width_bins
from palmares.models.classify import fit_classifier, score, tree
from palmares.models.forecast import Autoregression
from palmares.operators.filters import apply_filters
from palmares.operators.gaps import with_group_count
from palmares.operators.impute import fill_body_measures, fill_with_group_mean
from palmares.operators.sampling import split, time_folds
from palmares.sources.files import export_csv, read_fact_csv
from pyspark.sql import functions as F, types as T

import pytest

PERSON = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("age", T.DoubleType())])


def test_quotes_order_and_bad_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,more,AGE,id\n"Anna ""Annie"" Kowal, Jr.",x,24,1\nNA,y,24y,2\n')
    rows = [tuple(r) for r in read_fact_csv(spark, str(tmp_path / "a.csv"), PERSON).collect()]
    assert rows == [(1, 'Anna "Annie" Kowal, Jr.', 24.0), (2, None, None)]
    with pytest.raises(Exception):
        read_fact_csv(spark, str(tmp_path / "a.csv"), PERSON, strict=True).collect()
    (tmp_path / "b.csv").write_text("id,name\n1,x\n")
    with pytest.raises(ValueError, match="age"):
        read_fact_csv(spark, str(tmp_path / "b.csv"), PERSON)


def test_export_reads_back_and_reruns(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c\\', 1.5), (2, None, None)], PERSON)
    for _ in range(2):
        export_csv(rows, str(tmp_path / "out"), "overwrite")
    assert sorted(map(tuple, read_fact_csv(spark, str(tmp_path / "out"), PERSON).collect())) == [(1, 'a "b", c\\', 1.5), (2, None, None)]


def test_null_keys_are_a_group(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), (None, 4.0), (None, None)], "k string, v double")
    assert sorted(r["n"] for r in with_group_count(rows, "k", "n").collect()) == [2, 2, 2, 2]
    assert sorted((str(r["k"]), r["v"]) for r in fill_with_group_mean(rows, ["v"], "k").collect()) == [("None", 4.0), ("None", 4.0), ("a", 1.0), ("a", 1.0)]


def test_short_series_are_reported(spark):
    rows = spark.createDataFrame([("a", y, float(y)) for y in range(12)] + [("b", 1, 1.0), ("b", 2, 2.0)], "s string, t int, v double")
    folds = time_folds(rows, "t", 5, ["s"])
    assert sorted((r["t"], r["fold"], r["role"]) for r in folds.filter("s = 'b'").collect()) == [(1, None, "too_short"), (2, None, "too_short")]
    assert folds.filter("s = 'a' AND role = 'test'").count() == 10
    errors = Autoregression(1).validate(rows, ["s"], "t", "v").collect()
    assert [(r["fold"], r["mae"], r["status"]) for r in errors if r["s"] == "b"] == [(None, None, "too_short")]
    # The first fold trains on two rows, too few for a lag.
    assert {r["fold"]: r["status"] for r in errors if r["s"] == "a"} == {1: "repeats last value", 2: "ok", 3: "ok", 4: "ok", 5: "ok"}


def test_outer_edges_hold_every_value(spark):
    rows = spark.range(101).select((F.col("id") / 1000 + 0.007).alias("x"))
    assert equal_width_bins(rows, "x", "bin", labelled=8).count() == 101


def test_text_values_on_number_columns(spark, tmp_path):
    spark.createDataFrame([(24.0, 1995), (25.5, 1996), (None, 1995)], "age double, year int").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert [r["age"] for r in apply_filters(rows, {"age": ["24", "none"]}).collect()] == [24.0]
    assert [r["age"] for r in apply_filters(rows, {"age": ["25.5"]}).collect()] == [25.5]
    assert apply_filters(rows, {"age": ["none"]}).count() == 0
    chosen = apply_filters(rows, {"year": ["1995"]})
    assert chosen.count() == 2 and "year,1995" in chosen._jdf.queryExecution().executedPlan().toString()


def test_scoring_keeps_incomplete_rows(spark):
    rows = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "x double, actual int")
    model = fit_classifier(rows, tree(), ["x"])
    scored = score(model, rows.unionAll(spark.createDataFrame([(None, 1), (float("nan"), 0)], rows.schema))).collect()
    assert len(scored) == 22 and sum(r["predicted"] is None and r["predicted_name"] is None for r in scored) == 2


def test_imputation_and_splits_do_not_depend_on_partitions(spark):
    draw = random.Random(5)
    some = lambda lo, hi: None if draw.random() < 0.3 else draw.uniform(lo, hi)
    rows = spark.createDataFrame([(i, f"s{i % 3}", some(150, 200), some(50, 99)) for i in range(3000)], "id int, sport string, height double, weight double")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            filled = fill_body_measures(rows.repartition(n))
            found.append(sorted(map(tuple, split(filled, ["sport", "height", "weight"], 80).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 3000


def test_status_names_the_order_used(spark):
    rows = spark.createDataFrame(
        [(s, t, "history", float(t * t)) for s, n in (("long", 12), ("short", 7), ("one", 1)) for t in range(n)]
        + [(s, 99, "forecast", None) for s in ("long", "short", "one", "none")], "s string, t int, kind string, v double")
    found = {r["s"]: (r["status"], r["yhat"] is None) for r in Autoregression().forecast(rows, ["s"], "t", "v").collect()}
    assert found == {"long": ("ok", False), "short": ("lags=2", False), "one": ("repeats last value", False), "none": ("no history", True)}


def test_one_country_moves_before_the_young_golds_are_chosen(spark):
    from palmares.plans.doubles import double_winners

    rows = [(name, "Gold", 20.0, continent, noc, "Rowing", year) for name, continent, noc in [("a", "Europe", "RUS"), ("b", "Europe", "POL")] for year in (2000, 2004)]
    df = spark.createDataFrame(rows, "name string, medal string, age double, continent string, noc string, sport string, year int")
    names = lambda **options: {r["name"] for r in double_winners(df, **options).collect()}
    assert names() == {"a", "b"}
    assert names(moved=("RUS", "Asia")) == {"b"}
    assert names(moved=("RUS", "Asia"), continent="Asia") == {"a"}


def test_a_chosen_country_stands_for_its_predecessors(spark):
    from palmares.plans.doubles import golds_by_age

    rows = [(2000 + i, 20.0, "Male", noc, "Gold") for i, noc in enumerate(["GER", "GDR", "FRG", "POL"])]
    winners = spark.createDataFrame(rows, "year int, age double, sex string, noc string, medal string")
    assert sorted(r["year"] for r in golds_by_age(winners, {"noc": ["GER"]}).collect()) == [2000, 2001, 2002]
