"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palmares.catalog.join import TYPICAL_SQL
from palmares.catalog.registry import half_up, query
from palmares.operators.aggregates import (
    category_pivot, count_by, distinct_count_by, distinct_levels, exact_distinct_levels, hierarchy, share, sketch_error, sum_by,
    typical_category, with_root_share, won,
    yearly_profile,
)
from palmares.operators.impute import group_mean
from palmares.operators.quality import non_null_counts
from palmares.operators.ranking import one_per_key
from palmares.plans.doubles import flows
from palmares.plans.roles import participation, raw_participation


@query("ag01_grouped_count", "SELECT sport, season, count(height) AS n FROM rv GROUP BY sport, season")
def counted_values(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(participation(spark, folder), ["sport", "season"], "height")


@query("ag02_grouped_rows", "SELECT year, age, sex, count(*) AS n FROM rv GROUP BY year, age, sex")
def counted_rows(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(participation(spark, folder), ["year", "age", "sex"])


@query("ag03_medal_pivot", """
SELECT sport, season, age_bin, count(*) FILTER (WHERE medal = 'Gold') AS gold, count(*) FILTER (WHERE medal = 'Silver') AS silver, count(*) FILTER (WHERE medal = 'Bronze') AS bronze,
  count(*) FILTER (WHERE medal <> 'No medal') AS total FROM rv GROUP BY ALL""")
def medal_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return category_pivot(participation(spark, folder), ["sport", "season", "age_bin"])


@query("ag04_mapped_sums", """
SELECT sport, count(*) FILTER (WHERE medal = 'Gold') AS golds, CAST(count(*) AS BIGINT) AS entries FROM rv GROUP BY sport""")
def mapped_sums(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).select("sport", (F.col("medal") == "Gold").cast("int").alias("gold"), F.lit(1).alias("one"))
    return rows.groupBy("sport").agg({"gold": "sum", "one": "sum"}).withColumnsRenamed(
        {"sum(gold)": "golds", "sum(one)": "entries"}
    )


@query("ag05_mean", "SELECT sport, height, round(avg(weight), 6) AS mean_weight FROM rv GROUP BY sport, height")
def mean_weights(spark: SparkSession, folder: str) -> DataFrame:
    means = group_mean(participation(spark, folder), "weight", ["sport", "height"], "mean_weight")
    return means.withColumn("mean_weight", F.round("mean_weight", 6))


@query("ag06_rounded_mean", f"SELECT year, season, sport, sex, {half_up('avg(age)')} AS mean_age FROM rv GROUP BY ALL")
def rounded_means(spark: SparkSession, folder: str) -> DataFrame:
    means = group_mean(participation(spark, folder), "age", ["year", "season", "sport", "sex"], "mean_age")
    return means.withColumn("mean_age", F.round("mean_age", 2))


@query("ag07_distinct_count", "SELECT continent, count(DISTINCT name) AS n FROM rv GROUP BY continent")
def distinct_athletes(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_count_by(participation(spark, folder), ["continent"], "name")


@query("ag08_sum", "SELECT continent, year, sum(age) AS age FROM rv GROUP BY continent, year")
def summed_ages(spark: SparkSession, folder: str) -> DataFrame:
    return sum_by(participation(spark, folder), ["continent", "year"], "age")


@query("ag09_extremes", """
SELECT min(age) AS min_age, max(age) AS max_age, min(height) AS min_height, max(height) AS max_height, min(year) AS min_year, max(year) AS max_year FROM rv""")
def extremes(spark: SparkSession, folder: str) -> DataFrame:
    return participation(spark, folder).agg(
        *[f(c).alias(f"{p}_{c}") for c in ("age", "height", "year") for p, f in (("min", F.min), ("max", F.max))]
    )


@query("ag10_value_set", "SELECT DISTINCT noc FROM raw")
def value_set(spark: SparkSession, folder: str) -> DataFrame:
    return raw_participation(spark, folder).select("noc").distinct()


@query("ag11_distinct_rows", "SELECT DISTINCT team, continent, season FROM rv")
def distinct_rows(spark: SparkSession, folder: str) -> DataFrame:
    return participation(spark, folder).select("team", "continent", "season").distinct()


@query("ag12_one_per_key", """
SELECT name, year, age, sport, event FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY year, age, sport, event) AS r FROM rv) WHERE r = 1""")
def first_entries(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).select("name", "year", "age", "sport", "event")
    return one_per_key(rows, ["name"], ["year", "age", "sport", "event"])


@query("ag13_distinct_whole_rows", "SELECT sport, count(*) AS n FROM (SELECT DISTINCT * FROM rv) GROUP BY sport")
def distinct_whole_rows(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(participation(spark, folder).dropDuplicates(), ["sport"])


@query("ag14_filtered_groups", """
SELECT name, count(*) AS golds FROM rv WHERE medal = 'Gold' AND age < 26 GROUP BY name HAVING count(*) >= 2""")
def double_golds(spark: SparkSession, folder: str) -> DataFrame:
    golds = participation(spark, folder).filter((F.col("medal") == "Gold") & (F.col("age") < 26))
    return count_by(golds, ["name"], target="golds").filter(F.col("golds") >= 2)


@query("ag15_typical_category", "SELECT sport, sex, age_bin, typical_medal FROM typical", TYPICAL_SQL)
def typical_medals(spark: SparkSession, folder: str) -> DataFrame:
    return typical_category(participation(spark, folder).filter(won()), ["sport", "sex", "age_bin"])


@query("ag16_hierarchy", """
SELECT continent, season, medal, medals, level, round(medals / max(CASE WHEN level = 1 THEN medals END) OVER (PARTITION BY continent), 6) AS share
FROM (SELECT continent, season, medal, count(*) AS medals, 3 - CAST(GROUPING(continent) + GROUPING(season) + GROUPING(medal) AS INTEGER) AS level
  FROM rv WHERE medal <> 'No medal' GROUP BY ROLLUP (continent, season, medal)) WHERE level >= 1""")
def medal_tree(spark: SparkSession, folder: str) -> DataFrame:
    path = ["continent", "season", "medal"]
    tree = hierarchy(participation(spark, folder).filter(won()), path, target="medals")
    return with_root_share(tree, path, "medals").withColumn("share", F.round("share", 6))


@query("ag17_non_null_counts", """
SELECT noc, count(age) AS n_age, count(height) AS n_height, count(weight) AS n_weight, count(medal) AS n_medal FROM raw GROUP BY noc""")
def known_values(spark: SparkSession, folder: str) -> DataFrame:
    return non_null_counts(raw_participation(spark, folder), ["age", "height", "weight", "medal"], ["noc"])


@query("ag18_share", """
SELECT age_bin, count(*) AS amount, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM rv WHERE medal <> 'No medal' GROUP BY age_bin""")
def age_shares(spark: SparkSession, folder: str) -> DataFrame:
    return share(participation(spark, folder).filter(won()), "age_bin").withColumn("share", F.round("share", 6))


@query("ag19_yearly_profile", """
SELECT year, season, continent, count(*) FILTER (WHERE medal <> 'No medal') AS medals, count(DISTINCT id) AS athletes,
  round(avg(age), 6) AS mean_age, round(avg(height), 6) AS mean_height, round(avg(weight), 6) AS mean_weight FROM rv GROUP BY ALL""")
def profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = yearly_profile(participation(spark, folder))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_age", "mean_height", "mean_weight")})


@query("ag20_map_counts", """
SELECT 'noc' AS kind, noc AS key, count(*) AS medals FROM rv WHERE medal <> 'No medal' GROUP BY noc
UNION ALL SELECT 'continent', continent, count(*) FROM rv WHERE medal <> 'No medal' GROUP BY continent""")
def map_counts(spark: SparkSession, folder: str) -> DataFrame:
    per_code = count_by(participation(spark, folder).filter(won()), ["continent", "noc"], target="medals")
    codes = per_code.select(F.lit("noc").alias("kind"), F.col("noc").alias("key"), "medals")
    regions = per_code.select(F.lit("continent").alias("kind"), F.col("continent").alias("key"), "medals")
    return codes.unionByName(regions).groupBy("kind", "key").agg(F.sum("medals").alias("medals"))


@query("ag21_series", """
SELECT age_bin, medal, count(*) AS medals FROM rv WHERE medal <> 'No medal' GROUP BY age_bin, medal""")
def stacked_series(spark: SparkSession, folder: str) -> DataFrame:
    groups = count_by(participation(spark, folder).filter(won()), ["year", "sport", "age_bin", "medal"], target="medals")
    return sum_by(groups, ["age_bin", "medal"], "medals")


@query("ag22_flows", """
SELECT continent, sex, age_bin, sport, season, century, medal, count(*) AS n FROM rv GROUP BY ALL""")
def category_flows(spark: SparkSession, folder: str) -> DataFrame:
    return flows(participation(spark, folder), ["continent", "sex", "age_bin", "sport", "season", "century", "medal"])


@query("ag07_distinct_levels", """
SELECT season, continent, sport, 3 - CAST(GROUPING(season) + GROUPING(continent) + GROUPING(sport) AS INTEGER) AS level, count(DISTINCT id) AS n, true AS close
FROM rv GROUP BY ROLLUP (season, continent, sport)""")
def distinct_athletes(spark: SparkSession, folder: str) -> DataFrame:
    """Different athletes at every level, exactly, and whether the estimate from united sketches is within five standard errors."""
    rows, path = participation(spark, folder), ["season", "continent", "sport"]
    exact = exact_distinct_levels(rows, path, "id")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*path, "level")]
    joined = exact.alias("e").join(distinct_levels(rows, path, "id", "estimate").alias("s"), same)
    close = F.abs(F.col("s.estimate") - F.col("e.n")) <= 5 * sketch_error() * F.col("e.n")
    return joined.select(*[f"e.{c}" for c in (*path, "level", "n")], close.alias("close"))
