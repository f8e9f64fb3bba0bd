"""Histories per entity, ordering, top-k and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palmares.catalog.join import TOP_SQL
from palmares.catalog.registry import query
from palmares.operators.aggregates import count_by
from palmares.operators.gaps import gap_label, row_lag, second_success, with_group_count, year_steps
from palmares.operators.impute import fill_with_group_mean, with_group_mean
from palmares.operators.quality import covers
from palmares.operators.ranking import one_per_key, top_k, top_k_per_group
from palmares.operators.series import history_with_future, horizon, lag_features
from palmares.plans.ages import season_top_sports
from palmares.plans.roles import code_lookup, participation, raw_participation
from palmares.sources.files import table


@query("wn01_group_count", """
SELECT gold_count, sport, count(*) AS n FROM (SELECT sport, count(*) OVER (PARTITION BY name) AS gold_count FROM rv WHERE medal = 'Gold') GROUP BY ALL""")
def golds_on_rows(spark: SparkSession, folder: str) -> DataFrame:
    golds = participation(spark, folder).filter(F.col("medal") == "Gold")
    return count_by(with_group_count(golds, "name", "gold_count"), ["gold_count", "sport"])


@query("wn02_lag", """
SELECT gap, count(*) AS n FROM (SELECT year - lag(year) OVER (PARTITION BY name ORDER BY year) AS gap FROM rv WHERE medal = 'Gold') GROUP BY gap""")
def lagged_years(spark: SparkSession, folder: str) -> DataFrame:
    golds = participation(spark, folder).filter(F.col("medal") == "Gold")
    steps = year_steps(golds, "name").select(F.inline(F.array(
        F.struct(F.col("gap"), F.lit(1).cast("bigint").alias("rows")),
        F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("rows")),
    )))
    return steps.filter(F.col("rows") > 0).groupBy("gap").agg(F.sum("rows").alias("n"))


@query("wn02_row_lag", """
SELECT name, year, prev_year, year - prev_year AS gap FROM (SELECT name, year, lag(year) OVER (PARTITION BY name ORDER BY year) AS prev_year FROM rv WHERE medal = 'Gold')""")
def lagged_rows(spark: SparkSession, folder: str) -> DataFrame:
    golds = participation(spark, folder).filter(F.col("medal") == "Gold").select("name", "year")
    return row_lag(golds, ["name"], ["year"], "year", "prev_year").withColumn("gap", F.col("year") - F.col("prev_year"))


@query("wn02_hot_key_lag", """
SELECT l_orderkey, l_linenumber, l_returnflag, lag(l_orderkey) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS former FROM lineitem""", roles=False)
def lagged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The order of the line before, in each of three groups that hold all rows between them."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return row_lag(lines, ["l_returnflag"], ["l_orderkey", "l_linenumber"], "l_orderkey", "former")


@query("wn03_first_row", """
SELECT age, sex, sport, count(*) AS n FROM (SELECT age, sex, sport, row_number() OVER (PARTITION BY name ORDER BY year, age, sport, event, sex) AS r
  FROM rv WHERE medal = 'Gold') WHERE r = 1 GROUP BY ALL""")
def first_golds(spark: SparkSession, folder: str) -> DataFrame:
    golds = participation(spark, folder).filter(F.col("medal") == "Gold").select("name", "year", "age", "sport", "event", "sex")
    return count_by(one_per_key(golds, ["name"], ["year", "age", "sport", "event", "sex"]), ["age", "sex", "sport"])


@query("wn04_window_fill", """
SELECT sport, count(*) FILTER (WHERE height IS NULL) AS n_filled, round(avg(h), 6) AS mean_height FROM (
  SELECT sport, height, coalesce(height, avg(height) OVER (PARTITION BY sport)) AS h FROM rv) GROUP BY sport""")
def filled_heights(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).withColumn("missing", F.col("height").isNull())
    return fill_with_group_mean(rows, ["height"], "sport").groupBy("sport").agg(
        F.count_if("missing").alias("n_filled"), F.round(F.avg("height"), 6).alias("mean_height")
    )


@query("wn05_group_mean", """
SELECT noc, count(*) FILTER (WHERE age < m) AS younger, count(*) FILTER (WHERE age >= m) AS older FROM (SELECT noc, age, avg(age) OVER (PARTITION BY sport, sex) AS m FROM rv) GROUP BY noc""")
def against_group_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_group_mean(participation(spark, folder), "age", ["sport", "sex"], "mean_age")
    return rows.groupBy("noc").agg(
        F.count_if(F.col("age") < F.col("mean_age")).alias("younger"), F.count_if(F.col("age") >= F.col("mean_age")).alias("older")
    )


@query("wn06_second_success", """
SELECT name, min(year) AS first_year, CASE max(CASE WHEN r = 2 THEN gap END) WHEN 0 THEN 'S.Y.' ELSE CAST(max(CASE WHEN r = 2 THEN gap END) AS VARCHAR) END AS years_to_two
FROM (SELECT name, year, year - lag(year) OVER (PARTITION BY name ORDER BY year) AS gap, row_number() OVER (PARTITION BY name ORDER BY year) AS r
  FROM rv WHERE medal = 'Gold') GROUP BY name""")
def second_golds(spark: SparkSession, folder: str) -> DataFrame:
    golds = participation(spark, folder).filter(F.col("medal") == "Gold")
    return second_success(golds, "name").select("name", "first_year", gap_label().alias("years_to_two"))


@query("wn07_lag_features", """
SELECT month, n, d1, lag(d1, 1) OVER (ORDER BY month) AS lag1, lag(d1, 2) OVER (ORDER BY month) AS lag2, lag(d1, 3) OVER (ORDER BY month) AS lag3,
  lag(d1, 4) OVER (ORDER BY month) AS lag4, lag(d1, 5) OVER (ORDER BY month) AS lag5
FROM (SELECT month, n, n - lag(n) OVER (ORDER BY month) AS d1 FROM (
  SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month, count(*) AS n FROM orders GROUP BY 1))""", roles=False)
def monthly_lags(spark: SparkSession, folder: str) -> DataFrame:
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month")
    return lag_features(count_by(table(spark, folder, "orders").select(month), ["month"]), "month", "n")


@query("sl01_sort_ascending", "SELECT year, season, sport, count(*) AS n FROM rv GROUP BY ALL ORDER BY year, season, sport")
def sorted_groups(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(participation(spark, folder), ["year", "season", "sport"]).orderBy("year", "season", "sport")


@query("sl02_sort_descending", "SELECT noc, count(*) AS n FROM rv GROUP BY noc ORDER BY n DESC, noc")
def sorted_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(participation(spark, folder), ["noc"]).orderBy(F.desc("n"), "noc")


@query("sl03_top_k", "SELECT name, count(*) AS n FROM rv WHERE medal <> 'No medal' GROUP BY name ORDER BY n DESC, name LIMIT 5")
def top_athletes(spark: SparkSession, folder: str) -> DataFrame:
    medals = participation(spark, folder).filter(F.col("medal") != "No medal")
    return top_k(count_by(medals, ["name"]), 5, ties=["name"])


@query("sl04_top_k_per_group", """
SELECT season, name, n, rank FROM (SELECT season, name, count(*) AS n, CAST(row_number() OVER (PARTITION BY season ORDER BY count(*) DESC, name) AS INTEGER) AS rank
  FROM rv GROUP BY season, name) WHERE rank <= 3""")
def top_athletes_per_season(spark: SparkSession, folder: str) -> DataFrame:
    return top_k_per_group(count_by(participation(spark, folder), ["season", "name"]), ["season"], 3, ties=["name"])


@query("sl05_sort_time", "SELECT year, n FROM (SELECT year, count(*) AS n FROM rv GROUP BY year) ORDER BY year")
def sorted_years(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(participation(spark, folder), ["year"]).orderBy("year")


@query("so01_union", "SELECT sport, count(*) AS lists FROM top GROUP BY sport", TOP_SQL)
def united_lists(spark: SparkSession, folder: str) -> DataFrame:
    listed = season_top_sports(participation(spark, folder))
    summer, winter = (listed.filter(F.col("season") == s).select("sport") for s in ("Summer", "Winter"))
    return count_by(summer.unionByName(winter), ["sport"], target="lists")


@query("so02_history_and_future", """
SELECT year, y, 'history' AS kind FROM (SELECT year, count(*) AS y FROM rv GROUP BY year)
UNION ALL SELECT last + 2 * i, NULL, 'forecast' FROM (SELECT max(year) AS last FROM rv), (SELECT unnest([1, 2, 3, 4, 5]) AS i)""")
def history_and_future(spark: SparkSession, folder: str) -> DataFrame:
    history = count_by(participation(spark, folder), ["year"], target="y")
    return history_with_future(history, horizon(history, "year", 5, 2))


@query("so03_subset_test", """
SELECT count(*) AS n_keys, count(*) FILTER (WHERE noc NOT IN (SELECT ioc FROM codes)) AS n_missing, count(*) FILTER (WHERE noc NOT IN (SELECT ioc FROM codes)) = 0 AS complete
FROM (SELECT DISTINCT noc FROM raw)""")
def subset_test(spark: SparkSession, folder: str) -> DataFrame:
    return covers(raw_participation(spark, folder), "noc", code_lookup(spark, folder), "ioc")
