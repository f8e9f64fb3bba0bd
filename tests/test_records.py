"""CSV cells with line breaks, across the borders of splits, against Python's own reader."""

import csv
import random

import pytest
from pyspark.sql import types as T

from palmares.sources.files import bad_cells, export_csv, read_fact_csv
from palmares.sources.records import records

KIND = T.StructType([T.StructField("ID", T.IntegerType()), T.StructField("Name", T.StringType()), T.StructField("Age", T.DoubleType())])


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_breaks_across_splits(spark, tmp_path, small_splits):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice(['a', 'b', '"', ",", "\n", "\r\n", " ", "é"]) for _ in range(draw.randrange(0, 60)))
    rows = [(i, f"x{word()}y", draw.choice(["1.5", "NA", "", "old"])) for i in range(150)]
    (tmp_path / "in").mkdir()
    for part in range(3):
        with open(tmp_path / "in" / f"{part}.csv", "w", newline="", encoding="utf-8") as file:
            out = csv.writer(file, lineterminator="\r\n" if part == 1 else "\n")
            out.writerow(["ID", "Name", "Age"])
            out.writerows(rows[part * 50:part * 50 + 50])
    path = str(tmp_path / "in")
    found = {r["ID"]: (r["Name"], r["Age"]) for r in read_fact_csv(spark, path, KIND).collect()}
    assert found == {i: (name, 1.5 if age == "1.5" else None) for i, name, age in rows}
    report = {r["column"]: (r["n"], r["n_missing"], r["n_bad"]) for r in bad_cells(spark, path, KIND).collect()}
    ages = [a for _, _, a in rows]
    assert report == {"ID": (150, 0, 0), "Name": (150, 0, 0), "Age": (150, ages.count("NA") + ages.count(""), ages.count("old"))}
    assert sum(r["first"] for r in records(spark, path).collect()) == 3
    with pytest.raises(Exception):
        read_fact_csv(spark, path, KIND, strict=True).collect()


def test_two_lines_are_one_cell(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,Name,Age\n1,"A\nB",2\n2,C,3\n')
    assert sorted(map(tuple, read_fact_csv(spark, str(tmp_path / "a.csv"), KIND).collect())) == [(1, "A\nB", 2.0), (2, "C", 3.0)]
    (tmp_path / "b.csv").write_text("ID,Name,Age\n")
    assert read_fact_csv(spark, str(tmp_path / "b.csv"), KIND).collect() == []


def test_an_open_quote_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,Name,Age\n1,"A,2\n' + "2,C,3\n" * 50)
    with pytest.raises(ValueError, match="51 lines"):
        records(spark, str(tmp_path / "a.csv"), most_lines=20)


def test_export_with_breaks_reads_back(spark, tmp_path):
    rows = [(1, 'a "b",\n"c"\n', 1.5), (2, None, None), (3, "plain", 2.0)]
    export_csv(spark.createDataFrame(rows, KIND), str(tmp_path / "out"))
    assert sorted(map(tuple, read_fact_csv(spark, str(tmp_path / "out"), KIND).collect())) == rows
