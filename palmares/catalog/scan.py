"""Sources, sinks and the table catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from palmares.catalog.registry import query
from palmares.operators.quality import null_profile
from palmares.plans.etl import split_games
from palmares.plans.medals import medal_groups, medal_table, yearly_features
from palmares.plans.roles import DEFAULT_CODE, code_rows, participation, raw_participation
from palmares.schemas import LOOKUP, RAW
from palmares.sources.files import bad_cells, clean_lookup, export_csv, read_fact_csv
from palmares.sources.tables import append_table, create_database, list_tables, overwrite_table, peek
from palmares.store import new_path


def new_database(spark: SparkSession) -> str:
    """A fresh database whose tables lie in the shared folder."""
    name = f"palmares_{uuid.uuid4().hex}"
    create_database(spark, name, new_path(spark, name))
    return name


NOTED_SQL = "noted AS (SELECT *, CASE id % 5 WHEN 0 THEN name || ' \"' || sport || '\", ' || city WHEN 1 THEN name || chr(10) || '\"' || city || ',\"' || chr(10) ELSE name END AS note FROM raw)"


def exported_fact(spark: SparkSession, folder: str) -> str:
    """The raw rows as CSV files whose names hold quotes, commas and line breaks, and whose ages are a text in some rows."""
    path, id_ = new_path(spark, "fact-csv"), F.col("id") % 5
    quoted = F.concat("name", F.lit(' "'), "sport", F.lit('", '), "city")
    broken = F.concat("name", F.lit('\n"'), "city", F.lit(',"\n'))
    rows = split_games(raw_participation(spark, folder)).withColumn("name", F.when(id_ == 0, quoted).when(id_ == 1, broken).otherwise(F.col("name")))
    rows = rows.withColumn("age", F.when(F.col("id") % 7 == 3, F.lit("old")).otherwise(F.col("age").cast("string")))
    export_csv(rows.select(*RAW.fieldNames()), path)
    return path


@query("io02_csv_scan", """
SELECT sport, count(*) AS n, count(sex) AS n_sex, count(age) FILTER (WHERE id % 7 <> 3) AS n_age, count(height) AS n_height,
  count(weight) AS n_weight, count(medal) AS n_medal, sum(age) FILTER (WHERE id % 7 <> 3) AS sum_age, min(split_part(games, ' ', 1)::INTEGER) AS first_year,
  count(DISTINCT note) AS n_notes, sum(length(note))::BIGINT AS letters
FROM noted GROUP BY sport""", NOTED_SQL)
def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    return read_fact_csv(spark, exported_fact(spark, folder)).groupBy("sport").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"n_{c}") for c in ("sex", "age", "height", "weight", "medal")],
        F.sum("age").alias("sum_age"),
        F.min("year").alias("first_year"),
        F.countDistinct("name").alias("n_notes"),
        F.sum(F.length("name")).alias("letters"),
    )


@query("io02_bad_cells", """
SELECT "column", n, CASE "column" WHEN 'sex' THEN no_sex WHEN 'age' THEN no_age WHEN 'medal' THEN no_medal END AS n_missing, CASE "column" WHEN 'age' THEN bad ELSE 0 END AS n_bad
FROM (SELECT count(*) AS n, count(*) - count(sex) AS no_sex, count(*) FILTER (WHERE age IS NULL AND id % 7 <> 3) AS no_age, count(*) - count(medal) AS no_medal,
  count(*) FILTER (WHERE id % 7 = 3) AS bad FROM raw), (SELECT unnest(['sex', 'age', 'medal']) AS "column")""")
def csv_bad_cells(spark: SparkSession, folder: str) -> DataFrame:
    found = bad_cells(spark, exported_fact(spark, folder))
    return found.withColumn("column", F.lower("column")).filter(F.col("column").isin("sex", "age", "medal"))


@query("io03_lookup_scan", "SELECT ioc, cc AS continent FROM codes")
def lookup_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "lookup-csv")
    code_rows(spark, folder).write.option("header", True).csv(path)
    return clean_lookup(spark.read.schema(LOOKUP).option("header", True).csv(path), blank=DEFAULT_CODE)


@query("io04_append_table", "SELECT season, 2 * count(*) AS n, 2 * sum(age) AS sum_age FROM rv GROUP BY season")
def append_twice(spark: SparkSession, folder: str) -> DataFrame:
    name = f"{new_database(spark)}.participation"
    for _ in range(2):
        append_table(participation(spark, folder), name, ["century"])
    return spark.table(name).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("age").alias("sum_age"))


@query("io05_overwrite_table", "SELECT season, count(*) AS n, sum(age) AS sum_age FROM rv GROUP BY season")
def overwrite_twice(spark: SparkSession, folder: str) -> DataFrame:
    name = f"{new_database(spark)}.participation"
    for _ in range(2):
        overwrite_table(participation(spark, folder), name, ["century"])
    return spark.table(name).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("age").alias("sum_age"))


@query("io06_csv_export", "SELECT medal, count(*) AS n, count(height) AS n_height, sum(age) AS sum_age FROM rv GROUP BY medal")
def csv_export(spark: SparkSession, folder: str) -> DataFrame:
    rows, path = participation(spark, folder), new_path(spark, "prepared-csv")
    export_csv(rows, path)
    return read_fact_csv(spark, path, rows.schema).groupBy("medal").agg(
        F.count(F.lit(1)).alias("n"), F.count("height").alias("n_height"), F.sum("age").alias("sum_age")
    )


@query("io10_list_tables", """
SELECT 'medal_groups' AS "table", count(*) AS n FROM (SELECT DISTINCT continent, season, medal, sex, age_bin FROM rv WHERE medal <> 'No medal')
UNION ALL SELECT 'medal_table', count(*) FROM (SELECT DISTINCT continent, season FROM rv WHERE medal <> 'No medal')
UNION ALL SELECT 'yearly_profile', count(*) FROM (SELECT DISTINCT year, season, continent FROM rv)""")
def table_inventory(spark: SparkSession, folder: str) -> DataFrame:
    rows, database = participation(spark, folder), new_database(spark)
    overwrite_table(medal_groups(rows), f"{database}.medal_groups")
    overwrite_table(medal_table(rows), f"{database}.medal_table")
    overwrite_table(yearly_features(rows), f"{database}.yearly_profile")
    counted = None
    for entry in list_tables(spark, database).collect():
        one = spark.table(f"{database}.{entry['table']}").agg(F.count(F.lit(1)).alias("n"))
        one = one.select(F.lit(entry["table"]).alias("table"), "n")
        counted = one if counted is None else counted.unionByName(one)
    return counted


@query("io11_peek_table", """
SELECT continent, season, medal, sex, age_bin, count(*) AS medals FROM rv WHERE medal <> 'No medal' GROUP BY ALL
ORDER BY continent, season, medal, sex, age_bin LIMIT 5""")
def peek_table(spark: SparkSession, folder: str) -> DataFrame:
    name = f"{new_database(spark)}.medal_groups"
    overwrite_table(medal_groups(participation(spark, folder)), name)
    return peek(spark, name, order=["continent", "season", "medal", "sex", "age_bin"])


@query("io14_preview", """
SELECT name, year, season, sport, event, age, medal FROM rv ORDER BY name, year, season, sport, event, age, medal LIMIT 10""")
def preview(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["name", "year", "season", "sport", "event", "age", "medal"]
    return participation(spark, folder).select(*columns).orderBy(*columns).limit(10)


@query("io15_schema_profile", """
SELECT c AS "column", t AS data_type, n_null, n_not_null FROM (
  SELECT 'id' AS c, 'bigint' AS t, count(*) - count(id) AS n_null, count(id) AS n_not_null FROM raw
  UNION ALL SELECT 'name', 'string', count(*) - count(name), count(name) FROM raw
  UNION ALL SELECT 'sex', 'string', count(*) - count(sex), count(sex) FROM raw
  UNION ALL SELECT 'age', 'double', count(*) - count(age), count(age) FROM raw
  UNION ALL SELECT 'height', 'double', count(*) - count(height), count(height) FROM raw
  UNION ALL SELECT 'weight', 'double', count(*) - count(weight), count(weight) FROM raw
  UNION ALL SELECT 'team', 'string', count(*) - count(team), count(team) FROM raw
  UNION ALL SELECT 'noc', 'string', count(*) - count(noc), count(noc) FROM raw
  UNION ALL SELECT 'games', 'string', count(*) - count(games), count(games) FROM raw
  UNION ALL SELECT 'city', 'string', count(*) - count(city), count(city) FROM raw
  UNION ALL SELECT 'sport', 'string', count(*) - count(sport), count(sport) FROM raw
  UNION ALL SELECT 'event', 'string', count(*) - count(event), count(event) FROM raw
  UNION ALL SELECT 'medal', 'string', count(*) - count(medal), count(medal) FROM raw)""")
def schema_profile(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_participation(spark, folder)
    types = F.create_map(*[F.lit(x) for field in raw.dtypes for x in field])
    return null_profile(raw, raw.columns).select("column", types[F.col("column")].alias("data_type"), "n_null", "n_not_null")
