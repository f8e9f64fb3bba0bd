"""Every registered query with SQL gives the rows of DuckDB; the others run and hold their shape."""

import pytest

import compare
from palmares.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, duck, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), duck, SQL[name]) == []


# Rows per query: series (2 seasons x 5 continents) or sexes, times years, folds or models.
SHAPES = {
    "ml05_boosted_trees": 10 * 5,
    "ml06_random_forest": 10 * 5,
    "ml07_age_forest": 2 * 5,
    "ml08_autoregression": 10 * 5,
    "ml09_trend_and_season": 10 * 10,
    "ml10_forest_classifier": 1,
    "ml11_tree_classifier": 4,
    "ml16_per_series_validation": 10 * 5 * 2,
    "q2e_age_forecast": 2 * 5 * 2,
    "q3d_medal_classifier": 5,
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_model_jobs_run(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert len(rows) == SHAPES.get(name, len(rows)) and rows
    for row in rows:
        values = row.asDict()
        for metric in ("accuracy", "precision", "recall"):
            assert 0 <= values.get(metric, 0) <= 1
        assert values.get("mae", 0) is None or values.get("mae", 0) >= 0
        if name.startswith(("ml05", "ml06", "ml07", "ml08_auto", "ml09")):
            assert values["yhat"] is not None
