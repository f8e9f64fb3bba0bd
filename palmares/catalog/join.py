"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palmares.catalog.registry import half_up, query
from palmares.operators.aggregates import count_by, distinct_count_by, typical_category, won, yearly_profile
from palmares.operators.impute import with_group_mean
from palmares.operators.joins import attach, keep_listed, lookup, match_listed
from palmares.operators.quality import missing_keys
from palmares.operators.ranges import range_label
from palmares.operators.ranking import top_k
from palmares.plans.ages import season_top_sports
from palmares.plans.medals import medal_map
from palmares.plans.roles import DEFAULT_CODE, code_lookup, participation, raw_participation
from palmares.sources.files import table
from palmares.store import stored

TOP_SQL = """top AS (SELECT season, sport FROM (
  SELECT season, sport, row_number() OVER (PARTITION BY season ORDER BY count(*) DESC, sport) AS r
  FROM rv WHERE medal <> 'No medal' AND century = 21 GROUP BY season, sport) WHERE r <= 3)"""


@query("jn01_list_inner", """
SELECT sport, count(*) AS n FROM rv JOIN (SELECT sport FROM top) USING (sport) WHERE medal <> 'No medal' GROUP BY sport""", TOP_SQL)
def listed_twice(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder)
    listed = stored(season_top_sports(rows).select("sport"), "top")
    return count_by(match_listed(rows.filter(won()), listed, "sport"), ["sport"])


@query("jn02_attach_one_key", """
SELECT sport, count(*) FILTER (WHERE height > m) AS taller, count(*) FILTER (WHERE height < m) AS shorter FROM (
  SELECT sport, height, avg(height) OVER (PARTITION BY sport) AS m FROM rv) GROUP BY sport""")
def against_sport_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_group_mean(participation(spark, folder), "height", ["sport"], "mean_height")
    return rows.groupBy("sport").agg(
        F.count_if(F.col("height") > F.col("mean_height")).alias("taller"),
        F.count_if(F.col("height") < F.col("mean_height")).alias("shorter"),
    )


@query("jn03_attach_two_keys", """
SELECT sport, count(*) FILTER (WHERE weight > m) AS heavier, count(*) FILTER (WHERE weight < m) AS lighter FROM (
  SELECT sport, weight, CASE WHEN height IS NOT NULL THEN avg(weight) OVER (PARTITION BY sport, height) END AS m FROM rv)
GROUP BY sport""")
def against_height_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_group_mean(participation(spark, folder), "weight", ["sport", "height"], "mean_weight")
    return rows.groupBy("sport").agg(
        F.count_if(F.col("weight") > F.col("mean_weight")).alias("heavier"),
        F.count_if(F.col("weight") < F.col("mean_weight")).alias("lighter"),
    )


@query("jn04_join_filtered_groups", """
SELECT noc, count(*) AS n, CAST(sum(gold_count) AS BIGINT) AS golds FROM rv JOIN (
  SELECT name, count(*) AS gold_count FROM rv WHERE medal = 'Gold' GROUP BY name HAVING count(*) >= 2) USING (name)
GROUP BY noc""")
def rows_of_double_winners(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder)
    golds = count_by(rows.filter(F.col("medal") == "Gold"), ["name"], target="gold_count")
    kept = attach(rows, golds.filter(F.col("gold_count") >= 2), "name", "inner")
    return kept.groupBy("noc").agg(F.count(F.lit(1)).alias("n"), F.sum("gold_count").alias("golds"))


@query("jn05_distinct_per_key", """
SELECT unique_sports, count(*) AS n FROM rv JOIN (SELECT name, count(DISTINCT sport) AS unique_sports FROM rv GROUP BY name) USING (name)
GROUP BY unique_sports""")
def sports_per_athlete(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder)
    return count_by(attach(rows, distinct_count_by(rows, ["name"], "sport", "unique_sports"), "name", "inner"), ["unique_sports"])


@query("jn06_left_scalar", """
SELECT continent, count(*) AS n, CAST(sum(coalesce(other_count, 0)) AS BIGINT) AS others FROM rv LEFT JOIN (
  SELECT name, count(*) AS other_count FROM rv WHERE medal <> 'Gold' GROUP BY name) USING (name)
WHERE medal = 'Gold' GROUP BY continent""")
def golds_with_others(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder)
    others = count_by(rows.filter(F.col("medal") != "Gold"), ["name"], target="other_count")
    golds = attach(rows.filter(F.col("medal") == "Gold"), others, "name").fillna(0, ["other_count"])
    return golds.groupBy("continent").agg(F.count(F.lit(1)).alias("n"), F.sum("other_count").alias("others"))


@query("jn07_lookup_default", """
SELECT noc, coalesce(cc, 'AM') AS continent, count(*) AS n FROM raw LEFT JOIN codes ON noc = ioc GROUP BY 1, 2""")
def looked_up(spark: SparkSession, folder: str) -> DataFrame:
    rows = lookup(
        raw_participation(spark, folder), "noc", code_lookup(spark, folder), "ioc", "continent", "continent", DEFAULT_CODE
    )
    return count_by(rows, ["noc", "continent"])


@query("jn08_semi_top_k", """
SELECT sport, count(*) AS n FROM rv WHERE sport IN (SELECT sport FROM rv GROUP BY sport ORDER BY count(*) DESC, sport LIMIT 5) GROUP BY sport""")
def largest_sports(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder)
    top = top_k(count_by(rows, ["sport"]), 5, ties=["sport"]).select("sport")
    return count_by(keep_listed(rows, F.broadcast(top), "sport"), ["sport"])


TYPICAL_SQL = """typical AS (SELECT sport, sex, age_bin, CASE WHEN g >= s AND g >= b THEN 'Gold' WHEN s >= g AND s >= b THEN 'Silver' ELSE 'Bronze' END AS typical_medal
  FROM (SELECT sport, sex, age_bin, count(*) FILTER (WHERE medal = 'Gold') AS g, count(*) FILTER (WHERE medal = 'Silver') AS s, count(*) FILTER (WHERE medal = 'Bronze') AS b
    FROM rv WHERE medal <> 'No medal' GROUP BY sport, sex, age_bin))"""


@query("jn09_composite_left", """
SELECT sport, sex, age_bin, n, typical_medal FROM (SELECT sport, sex, age_bin, count(*) AS n FROM rv GROUP BY ALL)
LEFT JOIN typical USING (sport, sex, age_bin)""", TYPICAL_SQL)
def with_typical(spark: SparkSession, folder: str) -> DataFrame:
    rows, keys = participation(spark, folder), ["sport", "sex", "age_bin"]
    typical = typical_category(rows.filter(won()), keys)
    return count_by(rows, keys).join(typical, keys, "left")


@query("jn10_fused_measures", """
SELECT year, continent, count(*) FILTER (WHERE medal <> 'No medal') AS medals, count(DISTINCT id) AS athletes, round(avg(age), 6) AS mean_age
FROM rv GROUP BY year, continent""")
def fused_measures(spark: SparkSession, folder: str) -> DataFrame:
    profile = yearly_profile(participation(spark, folder), ["year", "continent"], measures=["age"])
    return profile.withColumn("mean_age", F.round("mean_age", 6))


@query("jn11_merge_back", f"""
SELECT noc, medal_count, count(*) AS n, CAST(sum(average_age) AS DOUBLE) AS ages FROM rv
JOIN (SELECT noc, count(*) AS medal_count FROM rv WHERE medal <> 'No medal' GROUP BY noc) USING (noc)
JOIN (SELECT year, sport, CAST({half_up('avg(age)')} AS DECIMAL(10, 2)) AS average_age FROM rv GROUP BY year, sport) USING (year, sport)
GROUP BY noc, medal_count""")
def merged_back(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder)
    medals = count_by(rows.filter(won()), ["noc"], target="medal_count")
    merged = with_group_mean(attach(rows, medals, "noc"), "age", ["year", "sport"], "average_age", digits=2)
    exact = F.sum(F.col("average_age").cast("decimal(10,2)")).cast("double")
    return merged.groupBy("noc", "medal_count").agg(F.count(F.lit(1)).alias("n"), exact.alias("ages"))


@query("jn12_dimension_left", """
SELECT n_name, n_regionkey, medals FROM nation LEFT JOIN (
  SELECT noc, count(*) AS medals FROM rv WHERE medal <> 'No medal' AND continent = 'EUROPE' GROUP BY noc) ON n_name = noc""")
def nations_with_medals(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select("n_name", "n_regionkey")
    return medal_map(participation(spark, folder), nations, "n_name", continents=["EUROPE"])


@query("jn13_full_outer", """
SELECT year, y, yhat FROM (SELECT year, count(*) AS y FROM rv GROUP BY year)
FULL JOIN (SELECT year + 2 AS year, count(*) AS yhat FROM rv GROUP BY year) USING (year)""")
def actual_and_shifted(spark: SparkSession, folder: str) -> DataFrame:
    actual = count_by(participation(spark, folder), ["year"], target="y")
    shifted = actual.select((F.col("year") + 2).alias("year"), F.col("y").alias("yhat"))
    return actual.join(shifted, "year", "full_outer")


@query("jn14_range_lookup", """
SELECT sport, season, mean_age, min_by(age_bin, lo) AS age_bin FROM (SELECT sport, season, avg(age) AS mean_age FROM rv GROUP BY ALL)
LEFT JOIN (SELECT DISTINCT age_bin, CAST(split_part(age_bin, '-', 1) AS INT) AS lo, CAST(split_part(age_bin, '-', 2) AS INT) AS hi FROM rv)
ON floor(mean_age) BETWEEN lo AND hi GROUP BY ALL""")
def range_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder)
    means = rows.groupBy("sport", "season").agg(F.avg("age").alias("mean_age"))
    labels = rows.select("age_bin").distinct()
    return range_label(means, "mean_age", labels, "age_bin", "age_bin")


@query("jn15_missing_keys", """
SELECT noc AS missing_key, count(*) AS n FROM raw WHERE noc NOT IN (SELECT ioc FROM codes) GROUP BY noc""")
def unknown_codes(spark: SparkSession, folder: str) -> DataFrame:
    return missing_keys(raw_participation(spark, folder), "noc", code_lookup(spark, folder), "ioc")
