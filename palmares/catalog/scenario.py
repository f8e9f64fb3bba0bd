"""The preparation jobs and the four scenarios end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palmares.catalog.column import MEASURES_SQL
from palmares.catalog.join import TOP_SQL, TYPICAL_SQL
from palmares.catalog.registry import BMI, equal_width, half_up, query
from palmares.operators.aggregates import with_root_share
from palmares.operators.filters import expand_values
from palmares.operators.quality import non_null_counts
from palmares.plans.ages import (
    age_hierarchy, age_share, ages_with_typical_medal, medal_pivot_by_age, medals_of_top_sports, season_series, stacked_series,
)
from palmares.plans.bodies import axis_ranges, body_groups, body_hierarchy, body_points, country_bodies, parallel_axes
from palmares.plans.defaults import BODY_FILTERS
from palmares.plans.doubles import age_at_first_gold, double_winners, flows, golds_by_age, wait_share, winner_hierarchy
from palmares.plans.etl import prepare_early
from palmares.plans.medals import medal_groups, medal_hierarchy, medal_map, medal_table, medals_by_age
from palmares.plans.roles import (
    CONTINENT_CODES, DEFAULT_CODE, code_lookup, participation, prepare_roles, raw_participation,
)
from palmares.sources.files import table
from palmares.store import stored_once

COUNTRY = "NATION_3"


# Preparation


@query("q0_prepare", """
SELECT id, name, sex, age, height, weight, team, noc, games, city, sport, event, medal, year, season, century, age_bin, continent FROM rv""")
def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_roles(spark, folder)


@query("q0b_prepare_early", f"""
SELECT id, name, sex, age, round(height, 6) AS height, round(weight, 6) AS weight, noc, sport, event, medal, year, season,
  CASE WHEN age <= 20 THEN '1-20' WHEN age <= 30 THEN '21-30' WHEN age <= 40 THEN '31-40' WHEN age <= 50 THEN '41-50'
    WHEN age <= 60 THEN '51-60' WHEN age <= 70 THEN '61-70' END AS age_group,
  count(medal) OVER (PARTITION BY noc) AS medal_count, {half_up('avg(age) OVER (PARTITION BY year, sport)')} AS average_age,
  coalesce(codes.cc, 'AM') AS cc, names.continent
FROM (SELECT *, CAST(split_part(games, ' ', 1) AS INTEGER) AS year, split_part(games, ' ', 2) AS season FROM filled)
LEFT JOIN codes ON noc = ioc LEFT JOIN names ON names.cc = coalesce(codes.cc, 'AM')
WHERE height IS NOT NULL AND weight IS NOT NULL""",
       "h AS (SELECT raw.*, coalesce(height, avg(height) OVER (PARTITION BY sport)) AS h1 FROM raw WHERE age IS NOT NULL)",
       *MEASURES_SQL[1:])
def prepared_early(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare_early(raw_participation(spark, folder), code_lookup(spark, folder), CONTINENT_CODES, DEFAULT_CODE)
    return rows.withColumns({c: F.round(c, 6) for c in ("height", "weight")}).select(
        "id", "name", "sex", "age", "height", "weight", "noc", "sport", "event", "medal", "year", "season", "age_group",
        "medal_count", "average_age", "cc", "continent",
    )


# Scenario 1


@query("q1a_medal_groups", """
SELECT continent, season, medal, sex, age_bin, count(*) AS medals FROM rv WHERE medal <> 'No medal' GROUP BY ALL""")
def grouped_medals(spark: SparkSession, folder: str) -> DataFrame:
    return medal_groups(participation(spark, folder))


@query("q1b_medal_table", """
SELECT continent, season, count(*) FILTER (WHERE medal = 'Gold') AS gold, count(*) FILTER (WHERE medal = 'Silver') AS silver, count(*) FILTER (WHERE medal = 'Bronze') AS bronze, count(*) AS medals
FROM rv WHERE medal <> 'No medal' GROUP BY ALL""")
def tabled_medals(spark: SparkSession, folder: str) -> DataFrame:
    return medal_table(participation(spark, folder))


@query("q1b_medal_table_moved", """
SELECT continent, season, count(*) FILTER (WHERE medal = 'Gold') AS gold, count(*) FILTER (WHERE medal = 'Silver') AS silver, count(*) FILTER (WHERE medal = 'Bronze') AS bronze, count(*) AS medals
FROM (SELECT * REPLACE (CASE WHEN noc = 'NATION_3' THEN 'ASIA' ELSE continent END AS continent) FROM rv) WHERE medal <> 'No medal' GROUP BY ALL""")
def tabled_medals_moved(spark: SparkSession, folder: str) -> DataFrame:
    return medal_table(participation(spark, folder), (COUNTRY, "ASIA"))


@query("q1c_medals_by_age", """
SELECT continent, season, age_bin, count(*) AS medals FROM rv WHERE medal <> 'No medal' AND season = 'Winter' GROUP BY ALL""")
def winter_medals(spark: SparkSession, folder: str) -> DataFrame:
    return medals_by_age(participation(spark, folder), "Winter")


@query("q1d_country_map", """
SELECT n_name, medals FROM nation LEFT JOIN (SELECT noc, count(*) AS medals FROM rv WHERE medal <> 'No medal' GROUP BY noc) ON n_name = noc""")
def country_map(spark: SparkSession, folder: str) -> DataFrame:
    regions = table(spark, folder, "nation").select("n_name")
    return medal_map(participation(spark, folder), regions, "n_name", moved=(COUNTRY, "ASIA"))


@query("q1d_continent_map", """
SELECT n_name, r_name, medals FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (
  SELECT CASE WHEN noc = 'NATION_3' THEN 'ASIA' ELSE continent END AS continent, count(*) AS medals FROM rv
  WHERE medal <> 'No medal' AND continent IN ('EUROPE', 'AFRICA') GROUP BY 1) m ON r_name = m.continent""")
def continent_map(spark: SparkSession, folder: str) -> DataFrame:
    regions = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_name", "r_name")
    rows = participation(spark, folder)
    return medal_map(rows, regions, "r_name", "continent", ["EUROPE", "AFRICA"], (COUNTRY, "ASIA"))


@query("q1d_medal_hierarchy", """
SELECT continent, season, medal, sex, age_bin, count(*) AS medals,
  5 - CAST(GROUPING(continent) + GROUPING(season) + GROUPING(medal) + GROUPING(sex) + GROUPING(age_bin) AS INTEGER) AS level
FROM rv WHERE medal <> 'No medal' GROUP BY ROLLUP (continent, season, medal, sex, age_bin)""")
def medal_levels(spark: SparkSession, folder: str) -> DataFrame:
    return medal_hierarchy(participation(spark, folder), ["continent", "season", "medal", "sex", "age_bin"])


# Scenario 2


LED_SQL = (
    TOP_SQL,
    """led AS (SELECT year, season, sport, medal, sex, age_bin, count(*) AS medals FROM rv
  WHERE medal <> 'No medal' AND century = 21 AND sport IN (SELECT sport FROM top) GROUP BY ALL)""",
)


@query("q2a_top_sport_medals", "SELECT * FROM led", *LED_SQL)
def top_sport_medals(spark: SparkSession, folder: str) -> DataFrame:
    return medals_of_top_sports(participation(spark, folder))


@query("q2b_top_sport_pivot", """
SELECT sport, season, age_bin, CAST(sum(CASE WHEN medal = 'Gold' THEN medals ELSE 0 END) AS BIGINT) AS gold,
  CAST(sum(CASE WHEN medal = 'Silver' THEN medals ELSE 0 END) AS BIGINT) AS silver,
  CAST(sum(CASE WHEN medal = 'Bronze' THEN medals ELSE 0 END) AS BIGINT) AS bronze, CAST(sum(medals) AS BIGINT) AS medals
FROM led GROUP BY sport, season, age_bin""", *LED_SQL)
def top_sport_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return medal_pivot_by_age(participation(spark, folder))


@query("q2c_mean_age_medal", f"""
SELECT sport, sex, age_bin, year, season, mean_age, typical_medal FROM (
  SELECT *, CASE WHEN floor(mean_age) BETWEEN 1 AND 20 THEN '1-20' WHEN floor(mean_age) BETWEEN 21 AND 25 THEN '21-25'
    WHEN floor(mean_age) BETWEEN 26 AND 30 THEN '26-30' WHEN floor(mean_age) BETWEEN 31 AND 40 THEN '31-40'
    WHEN floor(mean_age) BETWEEN 41 AND 60 THEN '41-60' END AS age_bin
  FROM (SELECT year, season, sport, sex, {half_up('avg(age)')} AS mean_age FROM rv
    WHERE medal <> 'No medal' AND century = 21 AND sport IN (SELECT sport FROM top) GROUP BY ALL))
LEFT JOIN (SELECT * FROM typical WHERE sport IN (SELECT sport FROM top)) USING (sport, sex, age_bin)""", TOP_SQL, TYPICAL_SQL)
def mean_age_medal(spark: SparkSession, folder: str) -> DataFrame:
    return ages_with_typical_medal(participation(spark, folder))


@query("q2d_age_share", """
SELECT age_bin AS label, CAST(sum(medals) AS BIGINT) AS medals, round(sum(medals) / sum(sum(medals)) OVER (), 6) AS share
FROM led GROUP BY age_bin""", *LED_SQL)
def shares_by_age(spark: SparkSession, folder: str) -> DataFrame:
    shares = age_share(medals_of_top_sports(participation(spark, folder)), {"sport": []})
    return shares.withColumn("share", F.round("share", 6))


@query("q2d_age_sex_share", """
SELECT age_bin || ' (' || sex || ')' AS label, CAST(sum(medals) AS BIGINT) AS medals, round(sum(medals) / sum(sum(medals)) OVER (), 6) AS share
FROM led WHERE sport IN ('SMALL', 'MEDIUM', 'LARGE', 'PROMO', 'ECONOMY') AND sex IN ('Male', 'Female') GROUP BY 1""", *LED_SQL)
def shares_by_age_and_sex(spark: SparkSession, folder: str) -> DataFrame:
    shares = age_share(
        medals_of_top_sports(participation(spark, folder)),
        {"sport": ["SMALL", "MEDIUM", "LARGE", "PROMO", "ECONOMY"], "sex": []},
        {"sex": ["Male", "Female"]},
        by_sex=True,
    )
    return shares.withColumn("share", F.round("share", 6))


@query("q2f_age_hierarchy", """
SELECT year, sport, medal, medals, level, round(medals / max(CASE WHEN level = 1 THEN medals END) OVER (PARTITION BY year), 6) AS share
FROM (SELECT year, sport, medal, CAST(sum(medals) AS BIGINT) AS medals, 3 - CAST(GROUPING(year) + GROUPING(sport) + GROUPING(medal) AS INTEGER) AS level
  FROM led GROUP BY ROLLUP (year, sport, medal)) WHERE level >= 1""", *LED_SQL)
def age_levels(spark: SparkSession, folder: str) -> DataFrame:
    return age_hierarchy(medals_of_top_sports(participation(spark, folder))).withColumn("share", F.round("share", 6))


@query("q2f_season_series", """
SELECT age_bin, medal, sport, CAST(sum(medals) AS BIGINT) AS medals FROM led
WHERE season = 'Winter' AND sport IN ('SMALL', 'LARGE', 'PROMO', 'ECONOMY') AND sex IN ('Male', 'Female') GROUP BY ALL""", *LED_SQL)
def winter_series(spark: SparkSession, folder: str) -> DataFrame:
    """An empty choice of sexes stands for both."""
    return season_series(medals_of_top_sports(participation(spark, folder)), "Winter", {"sport": ["SMALL", "LARGE", "PROMO", "ECONOMY"], "sex": []})


@query("q2f_stacked_series", """
SELECT age_bin, medal, CAST(sum(medals) AS BIGINT) AS medals FROM led
WHERE sport IN ('SMALL', 'MEDIUM', 'PROMO') AND sex = 'Female' GROUP BY ALL""", *LED_SQL)
def age_series(spark: SparkSession, folder: str) -> DataFrame:
    return stacked_series(medals_of_top_sports(participation(spark, folder)), {"sport": ["SMALL", "MEDIUM", "PROMO"], "sex": ["Female"]})


# Scenario 3


BODY_SQL = (
    *MEASURES_SQL,
    "country AS (SELECT * FROM filled WHERE noc = 'NATION_3' AND height IS NOT NULL AND weight IS NOT NULL)",
    f"""measured AS (SELECT * FROM (SELECT *, {BMI} AS bmi FROM country
  WHERE sport IN (SELECT sport FROM country GROUP BY sport ORDER BY count(*) DESC, sport LIMIT 5)) WHERE bmi BETWEEN 18.5 AND 35)""",
    *equal_width("measured"),
    """profiles AS (SELECT CASE WHEN team = 'NATION_3-1' THEN 'NATION_3' ELSE team END AS team, sport, sex, height, weight, age, age_bin, bmi, bmi_bin, medal, medals
  FROM (SELECT team, sport, sex, height, weight, age, age_bin, bmi, bmi_bin, medal, count(*) AS medals FROM binned
    WHERE medal <> 'No medal' AND year >= 1945 GROUP BY ALL))""",
)


def medal_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles that all views of the scenario read, made once a session."""

    def build() -> DataFrame:
        return body_groups(country_bodies(participation(spark, folder), COUNTRY), rename={f"{COUNTRY}-1": COUNTRY})

    return stored_once(spark, (folder, "medal-profiles"), build)


@query("q3a_body_profiles", """
SELECT team, sport, sex, round(height, 6) AS height, round(weight, 6) AS weight, age, age_bin, bmi, bmi_bin, medal, medals FROM profiles""", *BODY_SQL)
def body_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return medal_profiles(spark, folder).withColumns({c: F.round(c, 6) for c in ("height", "weight")})


@query("q3b_body_hierarchy", """
SELECT team, sport, sex, medal, medals, level, round(medals / max(CASE WHEN level = 1 THEN medals END) OVER (PARTITION BY team), 6) AS share
FROM (SELECT team, sport, sex, medal, CAST(sum(medals) AS BIGINT) AS medals, 4 - CAST(GROUPING(team) + GROUPING(sport) + GROUPING(sex) + GROUPING(medal) AS INTEGER) AS level
  FROM (SELECT DISTINCT * FROM profiles) GROUP BY ROLLUP (team, sport, sex, medal)) WHERE level >= 1""", *BODY_SQL)
def body_levels(spark: SparkSession, folder: str) -> DataFrame:
    tree = body_hierarchy(medal_profiles(spark, folder), ["team", "sport", "sex", "medal"])
    return tree.withColumn("share", F.round("share", 6))


@query("q3b_body_series", """
SELECT age_bin, bmi_bin, sex, CAST(sum(medals) AS BIGINT) AS medals FROM profiles GROUP BY ALL""", *BODY_SQL)
def body_series(spark: SparkSession, folder: str) -> DataFrame:
    return medal_profiles(spark, folder).groupBy("age_bin", "bmi_bin", "sex").agg(F.sum("medals").alias("medals"))


@query("q3b_body_points", """
SELECT age, bmi, round(weight, 6) AS weight, sex, sport, medal FROM profiles
WHERE sport IN ('SMALL', 'PROMO', 'ECONOMY') AND age_bin IN ('1-20', '21-25', '26-30', '31-40')""", *BODY_SQL)
def chosen_points(spark: SparkSession, folder: str) -> DataFrame:
    """Age groups by their default list; all groups of the index, whose labels depend on the data."""
    points = body_points(medal_profiles(spark, folder), {"sport": ["SMALL", "PROMO", "ECONOMY"]}, {"age_bin": BODY_FILTERS["age_bin"]})
    return points.withColumn("weight", F.round("weight", 6))


@query("q3c_parallel_axes", """
SELECT sport, medal, sex, sport_at, medal_at, sex_at, age, bmi, CAST(sum(medals) AS BIGINT) AS medals FROM profiles
JOIN (SELECT sport, row_number() OVER (ORDER BY min((team, sport, sex, age, bmi, medal)), sport) - 1 AS sport_at FROM profiles GROUP BY sport) USING (sport)
JOIN (SELECT medal, row_number() OVER (ORDER BY min((team, sport, sex, age, bmi, medal)), medal) - 1 AS medal_at FROM profiles GROUP BY medal) USING (medal)
JOIN (SELECT sex, row_number() OVER (ORDER BY min((team, sport, sex, age, bmi, medal)), sex) - 1 AS sex_at FROM profiles GROUP BY sex) USING (sex)
GROUP BY ALL""", *BODY_SQL)
def body_axes(spark: SparkSession, folder: str) -> DataFrame:
    rows = parallel_axes(
        medal_profiles(spark, folder), ["sport", "medal", "sex"], ["team", "sport", "sex", "age", "bmi", "medal"]
    )
    keys = ["sport", "medal", "sex", "sport_at", "medal_at", "sex_at", "age", "bmi"]
    return rows.groupBy(*keys).agg(F.sum("medals").alias("medals"))


@query("q3c_axis_ranges", """
SELECT 'age' AS axis, min(age) AS lo, max(age) AS hi FROM profiles UNION ALL SELECT 'bmi', min(bmi), max(bmi) FROM profiles""", *BODY_SQL)
def body_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return axis_ranges(medal_profiles(spark, folder), ["age", "bmi"])


# Scenario 4


def winners_sql(sport: str) -> tuple[str, ...]:
    return (
        "golds AS (SELECT * FROM rv WHERE medal = 'Gold' AND age < 26 AND continent = 'EUROPE')",
        f"""chosen AS (SELECT name, count(*) AS gold_count, count(DISTINCT {sport}) AS unique_sports FROM golds GROUP BY name
  HAVING count(*) >= 2 AND count(DISTINCT {sport}) = 1)""",
        """waits AS (SELECT name, CASE WHEN gap = 0 THEN 'S.Y.' ELSE CAST(gap AS VARCHAR) END AS years_to_two FROM (
  SELECT name, year - lag(year) OVER (PARTITION BY name ORDER BY year) AS gap, row_number() OVER (PARTITION BY name ORDER BY year) AS r FROM golds)
  WHERE r = 2)""",
        "winners AS (SELECT * FROM golds JOIN chosen USING (name) JOIN waits USING (name))",
    )


def city_winners(spark: SparkSession, folder: str) -> DataFrame:
    return double_winners(participation(spark, folder), "EUROPE", sport="city")


WINNER_COLUMNS = [
    "name", "sex", "gold_count", "sport", "city", "season", "event", "age", "continent", "noc", "year", "medal",
    "unique_sports", "years_to_two",
]


@query("q4a_double_winners", f"SELECT {', '.join(WINNER_COLUMNS)} FROM winners", *winners_sql("city"))
def winners_in_one_city(spark: SparkSession, folder: str) -> DataFrame:
    return city_winners(spark, folder).select(*WINNER_COLUMNS)


@query("q4a_double_winners_by_sport", f"SELECT {', '.join(WINNER_COLUMNS)} FROM winners", *winners_sql("sport"))
def winners_in_one_sport(spark: SparkSession, folder: str) -> DataFrame:
    return double_winners(participation(spark, folder), "EUROPE").select(*WINNER_COLUMNS)


CHOSEN = {"season": [], "years_to_two": ["S.Y.", "1", "2"], "noc": expand_values(["NATION_3", "NATION_8"], {"NATION_8": ["NATION_13", "NATION_18"]})}
DEFAULTS = {"season": ["Summer", "Winter"]}
CHOSEN_SQL = "season IN ('Summer', 'Winter') AND years_to_two IN ('S.Y.', '1', '2') AND noc IN ('NATION_3', 'NATION_8', 'NATION_13', 'NATION_18')"


@query("q4b_golds_by_age", f"SELECT year, age, sex, count(*) AS n FROM winners WHERE {CHOSEN_SQL} GROUP BY year, age, sex", *winners_sql("city"))
def winners_by_age(spark: SparkSession, folder: str) -> DataFrame:
    return golds_by_age(city_winners(spark, folder), CHOSEN, DEFAULTS)


@query("q4c_age_at_first_gold", f"""
SELECT age, sex, city, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY year, age, city, event, sex) AS r FROM winners WHERE {CHOSEN_SQL})
WHERE r = 1 GROUP BY age, sex, city""", *winners_sql("city"))
def first_gold_ages(spark: SparkSession, folder: str) -> DataFrame:
    return age_at_first_gold(city_winners(spark, folder), CHOSEN, DEFAULTS, sport="city")


@query("q4d_wait_share", """
SELECT years_to_two AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM winners GROUP BY 1""", *winners_sql("city"))
def waits(spark: SparkSession, folder: str) -> DataFrame:
    return wait_share(city_winners(spark, folder)).withColumn("share", F.round("share", 6))


@query("q4d_wait_sex_share", """
SELECT years_to_two || ' (' || sex || ')' AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM winners
WHERE noc IN ('NATION_3', 'NATION_8', 'NATION_13', 'NATION_18') AND sex IN ('Male', 'Female') GROUP BY 1""", *winners_sql("city"))
def waits_by_sex(spark: SparkSession, folder: str) -> DataFrame:
    shares = wait_share(city_winners(spark, folder), {"noc": CHOSEN["noc"], "sex": []}, {"sex": ["Male", "Female"]}, by_sex=True)
    return shares.withColumn("share", F.round("share", 6))


@query("q4e_winner_hierarchy", """
SELECT continent, season, city, sex, years_to_two, n, level, round(n / max(CASE WHEN level = 1 THEN n END) OVER (PARTITION BY continent), 6) AS share
FROM (SELECT continent, season, city, sex, years_to_two, count(*) AS n,
    5 - CAST(GROUPING(continent) + GROUPING(season) + GROUPING(city) + GROUPING(sex) + GROUPING(years_to_two) AS INTEGER) AS level
  FROM winners GROUP BY ROLLUP (continent, season, city, sex, years_to_two)) WHERE level >= 1""", *winners_sql("city"))
def winner_levels(spark: SparkSession, folder: str) -> DataFrame:
    path = ["continent", "season", "city", "sex", "years_to_two"]
    tree = winner_hierarchy(city_winners(spark, folder), path)
    return with_root_share(tree, path, "n").withColumn("share", F.round("share", 6))


@query("q4e_winner_map", """
SELECT n_name, n_age, n_medal FROM nation LEFT JOIN (
  SELECT noc, count(age) AS n_age, count(medal) AS n_medal FROM winners GROUP BY noc) ON n_name = noc""", *winners_sql("city"))
def winner_map(spark: SparkSession, folder: str) -> DataFrame:
    counts = non_null_counts(city_winners(spark, folder), ["age", "medal"], ["noc"])
    regions = table(spark, folder, "nation").select("n_name")
    return regions.join(counts, F.col("n_name") == F.col("noc"), "left").drop("noc")


@query("q4e_winner_flows", """
SELECT continent, sex, age, years_to_two, season, gold_count, medal, count(*) AS n FROM winners GROUP BY ALL""", *winners_sql("city"))
def winner_flows(spark: SparkSession, folder: str) -> DataFrame:
    return flows(city_winners(spark, folder))
