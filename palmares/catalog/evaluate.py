"""Splits, samples, folds, metrics and series preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palmares.catalog.registry import query
from palmares.functions.recode import agreement, flag
from palmares.operators.aggregates import count_by, yearly_profile
from palmares.operators.metrics import binary_metrics, class_report, mean_absolute_error
from palmares.operators.sampling import exact_sample, split, time_folds
from palmares.operators.series import future_rows
from palmares.plans.doubles import achievement_series, cohort
from palmares.plans.roles import participation
from palmares.schemas import NO_MEDAL

HASH_SQL = "CAST('0x' || substr(md5('42|' || name), 1, 15) AS BIGINT)"


@query("ml01_split", f"""
SELECT CASE WHEN {HASH_SQL} % 100 < 80 THEN 'train' ELSE 'test' END AS part, sport, count(*) AS n FROM rv GROUP BY 1, 2""")
def parts(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(split(participation(spark, folder), ["name"], 80), ["part", "sport"])


@query("ml02_exact_sample", f"""
SELECT name, n FROM (SELECT name, count(*) AS n, row_number() OVER (ORDER BY {HASH_SQL} % 1048576, {HASH_SQL}, name) AS r FROM rv GROUP BY name)
WHERE r <= floor((SELECT count(DISTINCT name) FROM rv) * 20 / 100)""")
def sampled(spark: SparkSession, folder: str) -> DataFrame:
    return exact_sample(count_by(participation(spark, folder), ["name"]), ["name"], 20)


FOLDS_SQL = (
    """yearly AS (SELECT sport, year, count(*) AS y, row_number() OVER (PARTITION BY sport ORDER BY year) - 1 AS pos,
  count(*) OVER (PARTITION BY sport) AS n FROM rv GROUP BY sport, year)""",
    """folds AS (SELECT sport, year, y, CAST(fold AS INTEGER) AS fold, CASE WHEN pos < n - (6 - fold) * (n // 6) THEN 'train'
    WHEN pos < n - (5 - fold) * (n // 6) THEN 'test' END AS role
  FROM yearly, (SELECT unnest([1, 2, 3, 4, 5]) AS fold) WHERE n >= 6)""",
)


@query("ml03_time_folds", """
SELECT sport, year, y, fold, role FROM folds WHERE role IS NOT NULL
UNION ALL SELECT sport, year, y, NULL, 'too_short' FROM yearly WHERE n < 6""", *FOLDS_SQL)
def folds(spark: SparkSession, folder: str) -> DataFrame:
    yearly = count_by(participation(spark, folder), ["sport", "year"], target="y")
    return time_folds(yearly, "year", by=["sport"])


@query("ml04_mean_absolute_error", """
SELECT sport, fold, round(avg(abs(y - yhat)), 6) AS mae FROM folds JOIN (
  SELECT sport, fold, avg(y) AS yhat FROM folds WHERE role = 'train' GROUP BY ALL) USING (sport, fold) WHERE role = 'test' GROUP BY ALL
UNION ALL SELECT sport, NULL, round(avg(mae), 6) FROM (
  SELECT sport, fold, avg(abs(y - yhat)) AS mae FROM folds JOIN (
    SELECT sport, fold, avg(y) AS yhat FROM folds WHERE role = 'train' GROUP BY ALL) USING (sport, fold) WHERE role = 'test' GROUP BY ALL)
GROUP BY sport""", *FOLDS_SQL)
def errors_of_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = folds(spark, folder)
    means = rows.filter(F.col("role") == "train").groupBy("sport", "fold").agg(F.avg("y").alias("yhat"))
    tested = rows.filter(F.col("role") == "test").join(means, ["sport", "fold"])
    per_fold = mean_absolute_error(tested, "y", "yhat", ["sport", "fold"])
    overall = per_fold.groupBy("sport").agg(F.avg("mae").alias("mae"))
    return per_fold.unionByName(overall, allowMissingColumns=True).withColumn("mae", F.round("mae", 6))


SCORED_SQL = """scored AS (SELECT CASE WHEN medal = 'No medal' THEN 0 ELSE 1 END AS actual, CASE WHEN age < 45 THEN 1 ELSE 0 END AS predicted FROM rv)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Rows scored by a fixed rule: a medal for everybody under 45."""
    return participation(spark, folder).select(
        flag("medal", NO_MEDAL).alias("actual"), F.when(F.col("age") < 45, 1).otherwise(0).alias("predicted")
    )


@query("ml13_binary_metrics", """
SELECT count(*) AS n, round(count(*) FILTER (WHERE actual = predicted) / count(*), 6) AS accuracy,
  round(count(*) FILTER (WHERE actual = 1 AND predicted = 1) / count(*) FILTER (WHERE predicted = 1), 6) AS "precision",
  round(count(*) FILTER (WHERE actual = 1 AND predicted = 1) / count(*) FILTER (WHERE actual = 1), 6) AS recall FROM scored""", SCORED_SQL)
def metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = binary_metrics(scored(spark, folder), "actual", "predicted")
    return rows.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall")})


REPORT_SQL = """classes AS (SELECT CAST(c AS VARCHAR) AS class, count(*) FILTER (WHERE actual = c AND predicted = c) / count(*) FILTER (WHERE predicted = c) AS p,
    count(*) FILTER (WHERE actual = c AND predicted = c) / count(*) FILTER (WHERE actual = c) AS r, count(*) FILTER (WHERE actual = c) AS support
  FROM scored, (SELECT unnest([0, 1]) AS c) GROUP BY c)"""


@query("ml14_class_report", """
SELECT class, round(p, 6) AS "precision", round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, CAST(support AS BIGINT) AS support FROM classes
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(2 * p * r / (p + r)), 6), CAST(sum(support) AS BIGINT) FROM classes
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(2 * p * r / (p + r) * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM classes""", SCORED_SQL, REPORT_SQL)
def report(spark: SparkSession, folder: str) -> DataFrame:
    rows = class_report(scored(spark, folder), "actual", "predicted")
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("ml15_agreement", """
SELECT CASE WHEN actual = predicted THEN 'right' ELSE 'wrong' END || ' ' || CASE WHEN actual = 1 THEN 'positive' ELSE 'negative' END AS tag,
  count(*) AS n FROM scored GROUP BY 1""", SCORED_SQL)
def tags(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(scored(spark, folder).withColumn("tag", agreement("actual", "predicted")), ["tag"])


@query("ml17_future_rows", """
SELECT season, continent, CAST(y AS INTEGER) AS year, round(athletes, 6) AS athletes, round(mean_age, 6) AS mean_age,
  round(sin(2 * pi() * y / top), 6) AS year_sin, round(cos(2 * pi() * y / top), 6) AS year_cos FROM (
  SELECT season, continent, max(year) AS top, avg(athletes) AS athletes, avg(mean_age) AS mean_age FROM (
    SELECT year, season, continent, count(DISTINCT id) AS athletes, avg(age) AS mean_age FROM rv GROUP BY ALL) GROUP BY ALL),
  (SELECT unnest([2020, 2024, 2028, 2032, 2036]) AS y)""")
def future(spark: SparkSession, folder: str) -> DataFrame:
    rows = future_rows(yearly_profile(participation(spark, folder)))
    return rows.withColumns({c: F.round(c, 6) for c in ("athletes", "mean_age", "year_sin", "year_cos")})


@query("ml18_cohort_series", """
SELECT year, CAST(sum(gold_count + coalesce(other_count, 0)) AS BIGINT) AS y FROM golds JOIN winners USING (name) LEFT JOIN others USING (name)
GROUP BY year""",
       "golds AS (SELECT * FROM rv WHERE medal = 'Gold' AND age < 26 AND continent = 'EUROPE')",
       """winners AS (SELECT name, count(*) AS gold_count FROM golds GROUP BY name HAVING count(*) >= 2 AND count(DISTINCT city) = 1)""",
       "others AS (SELECT name, count(*) AS other_count FROM rv WHERE medal <> 'Gold' GROUP BY name)")
def cohort_series(spark: SparkSession, folder: str) -> DataFrame:
    return achievement_series(cohort(participation(spark, folder), "EUROPE", sport="city"))
