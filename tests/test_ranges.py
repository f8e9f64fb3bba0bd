"""Range lookup and data-driven bins against loops."""

import math
import random

import pytest

from palmares.functions.bins import equal_width_bins
from palmares.operators.ranges import parsed_ranges, pieces, range_label


def plain(x, labels, whole):
    """The first label, by lower bound and then by text, whose range holds the value."""
    if x is None or math.isnan(x):
        return None
    x = math.floor(x) if whole and math.isfinite(x) else x
    for lo, label, hi in sorted((float(t.split("-")[0]), t, float(t.split("-")[1])) for t in set(labels)):
        if lo <= x <= hi:
            return label
    return None


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("searched", [4096, 0])
def test_overlapping_ranges_of_any_width(spark, whole, searched):
    draw = random.Random(11)
    labels = ["0-0", "5-5", "5-9", "9-9", "3-5.5", "0.25-0.5", "100-2000000000", "150-160", "2000000001-9007199254740991", "40-40.5"]
    labels += [f"{a}-{a + draw.choice([0, 1, 3, 30])}" for a in (draw.randrange(60) for _ in range(30))] + [f"{a / 8}-{a / 8 + 1.5}" for a in range(400, 640, 9)]
    values = [None, float("nan"), float("inf"), -3.0, 5.0, 5.99, 9.0, 9.5, 0.3, 1999999999.5, 2000000000.7, 3e15, 1e300]
    values += [draw.randrange(-40, 800) / 8 for _ in range(200)]
    rows = spark.createDataFrame([(i, v, "mine") for i, v in enumerate(values)], "i long, x double, label string")
    table = spark.createDataFrame([(t,) for t in [*labels, *labels[:3], None, "x", "1-", "-3-4", "7"]], "label string").repartition(5)
    out = range_label(rows, "x", table, "label", "found", whole, searched_ranges=searched, buckets=16)
    assert out.columns == ["i", "x", "label", "found"]
    assert {r["i"]: r["found"] for r in out.collect()} == {i: plain(v, labels, whole) for i, v in enumerate(values)}


def test_pieces_are_sorted_and_do_not_overlap(spark):
    labels = spark.createDataFrame([("1-4",), ("2-3",), ("4-8",), ("4-6",), ("9-9",)], "label string")
    found = sorted(map(tuple, pieces(parsed_ranges(labels, "label")).collect()))
    assert found == [(1.0, False, 4.0, "1-4"), (4.0, True, 6.0, "4-6"), (6.0, True, 8.0, "4-8"), (9.0, False, 9.0, "9-9")]


def test_no_labels_and_wrong_order(spark):
    values = spark.createDataFrame([(19.2,)], "x double")
    labels = spark.createDataFrame([(None,), ("x",)], "label string")
    for searched in (4096, -1):
        assert range_label(values, "x", labels, "label", "found", searched_ranges=searched).first()["found"] is None
    with pytest.raises(Exception, match="not a range"):
        range_label(values, "x", spark.createDataFrame([("20-18",)], "label string"), "label", "found").collect()


def test_wide_lists_are_joined_by_equality(spark):
    labels = spark.range(20000).selectExpr("concat(id * 3, '-', id * 3 + 1) AS label")
    rows = spark.range(3000).selectExpr("CAST(id * 7 AS DOUBLE) AS x")
    out = range_label(rows, "x", labels, "label", "found")
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("x % 3 < 2").filter("found IS NULL").count() == 0 and out.filter("x % 3 = 2").filter("found IS NOT NULL").count() == 0


def test_bins_leave_nan_out_and_run_nothing_early(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(9)] + [(float("nan"),), (None,)], "x double")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    out = equal_width_bins(rows, "x", "bin", labelled=8)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
    assert {r["x"]: r["bin"] for r in out.collect()} == {0.0: "0.0-1.0"} | {float(i): f"{i}.01-{i + 1}.0" for i in range(1, 8)} | {8.0: "7.01-8.0"}
