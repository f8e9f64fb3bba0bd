"""Filters, projections, scalar functions, bins, imputation and encodings."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from palmares.catalog.registry import BMI, equal_width, half_up, query
from palmares.functions.bins import age_bin, bounds_label, decade_bin, equal_width_bins, equal_width_edges, label_bounds
from palmares.functions.recode import flag, override, recode, unflag
from palmares.functions.scalar import body_mass_index, century, decorated, new_year, round_even, word
from palmares.operators.aggregates import category_pivot, count_by, won, yearly_profile
from palmares.operators.encode import features, first_seen_index, label_index, standardise
from palmares.operators.filters import apply_filters, expand_values, member
from palmares.operators.impute import fill_body_measures, fill_with_group_mean
from palmares.operators.joins import lookup
from palmares.operators.projection import insert_after
from palmares.operators.quality import drop_null_keys, drop_report, null_profile
from palmares.operators.ranges import range_label
from palmares.operators.series import fixed_horizon, horizon, with_cyclic_year
from palmares.plans.roles import DEFAULT_CODE, code_lookup, participation, raw_participation
from palmares.schemas import MEDAL_NAMES, NO_MEDAL, SEX_NAMES

# Filters


@query("pf01_null_profile", """
SELECT c AS "column", n - k AS n_null, k AS n_not_null, round((n - k) * 100 / n, 6) AS pct_null FROM (
  SELECT 'sex' AS c, count(*) AS n, count(sex) AS k FROM raw
  UNION ALL SELECT 'age', count(*), count(age) FROM raw
  UNION ALL SELECT 'height', count(*), count(height) FROM raw
  UNION ALL SELECT 'weight', count(*), count(weight) FROM raw
  UNION ALL SELECT 'medal', count(*), count(medal) FROM raw)""")
def null_shares(spark: SparkSession, folder: str) -> DataFrame:
    profile = null_profile(raw_participation(spark, folder), ["sex", "age", "height", "weight", "medal"])
    return profile.withColumn("pct_null", F.round("pct_null", 6))


@query("pf02_drop_report", 'SELECT count(*) AS "before", count(sex) AS "after", count(*) - count(sex) AS removed FROM raw')
def removed_rows(spark: SparkSession, folder: str) -> DataFrame:
    return drop_report(raw_participation(spark, folder), ["sex"])


@query("pf03_drop_null_subset", """
SELECT sport, count(*) AS n FROM raw WHERE height IS NOT NULL AND weight IS NOT NULL GROUP BY sport""")
def measured_rows(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(drop_null_keys(raw_participation(spark, folder), ["height", "weight"]), ["sport"])


@query("pf04_drop_null_any", """
SELECT sport, count(*) AS n FROM raw WHERE sex IS NOT NULL AND age IS NOT NULL AND height IS NOT NULL
  AND weight IS NOT NULL AND medal IS NOT NULL GROUP BY sport""")
def complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(raw_participation(spark, folder).na.drop(), ["sport"])


@query("pf05_not_equal", "SELECT medal, count(*) AS n FROM rv WHERE medal <> 'No medal' GROUP BY medal")
def medal_rows(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(participation(spark, folder).filter(won()), ["medal"])


@query("pf06_equal", "SELECT sport, count(*) AS n FROM rv WHERE season = 'Summer' AND century = 21 GROUP BY sport")
def season_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).filter((F.col("season") == "Summer") & (F.col("century") == 21))
    return count_by(rows, ["sport"])


@query("pf07_ordering", """
SELECT noc, count(*) AS n FROM rv WHERE age >= 0 AND age < 26 AND year >= 1945 GROUP BY noc HAVING count(*) >= 2""")
def young_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).filter((F.col("age") >= 0) & (F.col("age") < 26) & (F.col("year") >= 1945))
    return count_by(rows, ["noc"]).filter(F.col("n") >= 2)


@query("pf08_closed_range", f"SELECT sport, count(*) AS n FROM rv WHERE {BMI} BETWEEN 18.5 AND 35 GROUP BY sport")
def healthy_rows(spark: SparkSession, folder: str) -> DataFrame:
    bmi = F.round(body_mass_index("weight", "height"), 2)
    return count_by(participation(spark, folder).filter(bmi.between(18.5, 35.0)), ["sport"])


@query("pf09_between_branches", """
SELECT CASE WHEN age BETWEEN 13 AND 17 THEN 'junior' WHEN age BETWEEN 18 AND 35 THEN 'senior' END AS class, count(*) AS n
FROM rv GROUP BY 1""")
def age_classes(spark: SparkSession, folder: str) -> DataFrame:
    age = F.col("age").cast("int")
    label = F.when(age.between(13, 17), F.lit("junior")).when(age.between(18, 35), F.lit("senior"))
    return count_by(participation(spark, folder).withColumn("class", label), ["class"])


@query("pf10_conjunction", """
SELECT sport, count(*) AS n FROM rv WHERE medal = 'Gold' AND age < 26 AND continent = 'EUROPE' GROUP BY sport""")
def young_golds_by_sport(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).filter(
        (F.col("medal") == "Gold") & (F.col("age") < 26) & (F.col("continent") == "EUROPE")
    )
    return count_by(rows, ["sport"])


@query("pf11_membership", "SELECT sport, count(*) AS n FROM rv WHERE sport IN ('SMALL', 'PROMO', 'ECONOMY') GROUP BY sport")
def listed_sports(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(participation(spark, folder).filter(F.col("sport").isin("SMALL", "PROMO", "ECONOMY")), ["sport"])


@query("pf12_filter_set", """
SELECT continent, sex, count(*) AS n FROM rv WHERE continent IN ('EUROPE', 'ASIA') AND sex IN ('Male', 'Female')
GROUP BY ALL""")
def chosen_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = apply_filters(
        participation(spark, folder), {"continent": ["EUROPE", "ASIA"], "sex": []}, {"sex": ["Male", "Female"]}
    )
    return count_by(rows, ["continent", "sex"])


@query("pf13_value_expansion", "SELECT noc, count(*) AS n FROM rv WHERE noc IN ('NATION_1', 'NATION_3', 'NATION_8', 'NATION_13') GROUP BY noc")
def expanded_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes = expand_values(["NATION_1", "NATION_3"], {"NATION_3": ["NATION_8", "NATION_13"]})
    return count_by(apply_filters(participation(spark, folder), {"noc": codes}), ["noc"])


@query("pf14_mixed_membership", """
SELECT sex, gold_count, count(*) AS n FROM golds
WHERE sex IN ('Male', '2', '3') AND CAST(gold_count AS VARCHAR) IN ('Male', '2', '3') GROUP BY ALL""",
       "golds AS (SELECT name, sex, count(*) AS gold_count FROM rv WHERE medal = 'Gold' GROUP BY name, sex)")
def mixed_list(spark: SparkSession, folder: str) -> DataFrame:
    chosen = ["Male", "2", "3"]
    golds = count_by(participation(spark, folder).filter(F.col("medal") == "Gold"), ["name", "sex"], target="gold_count")
    return count_by(golds.filter(member("sex", chosen) & member("gold_count", chosen)), ["sex", "gold_count"])


# Recodes and projections


@query("pf15_recode_keep", """
SELECT CASE sex WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' ELSE sex END AS sex, count(*) AS n FROM raw GROUP BY 1""")
def sex_names(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(raw_participation(spark, folder).withColumn("sex", recode("sex", SEX_NAMES)), ["sex"])


@query("pf16_recode_null", """
SELECT CASE medal WHEN 'G' THEN 'Gold' WHEN 'S' THEN 'Silver' WHEN 'B' THEN 'Bronze' ELSE 'No medal' END AS medal,
  count(*) AS n FROM raw GROUP BY 1""")
def medal_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw_participation(spark, folder)
    return count_by(rows.withColumn("medal", recode("medal", MEDAL_NAMES, null_as=NO_MEDAL)), ["medal"])


@query("pf17_decode_or_null", """
SELECT cc, CASE cc WHEN 'EU' THEN 'EUROPE' WHEN 'AS' THEN 'ASIA' END AS continent, count(*) AS n
FROM raw JOIN codes ON noc = ioc GROUP BY cc""")
def decoded_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows = lookup(raw_participation(spark, folder), "noc", code_lookup(spark, folder), "ioc", "continent", "cc", None)
    counts = count_by(rows.filter(F.col("cc").isNotNull()), ["cc"])
    return counts.withColumn("continent", recode("cc", {"EU": "EUROPE", "AS": "ASIA"}, default=None))


@query("pf18_key_override", """
SELECT CASE WHEN noc = 'NATION_3' THEN 'ASIA' ELSE continent END AS continent, count(*) AS n FROM rv GROUP BY 1""")
def moved_country(spark: SparkSession, folder: str) -> DataFrame:
    moved = override("continent", "noc", "NATION_3", "ASIA")
    return count_by(participation(spark, folder).withColumn("continent", moved), ["continent"])


@query("pf19_medal_flag", """
SELECT sport, count(*) AS n, count(*) FILTER (WHERE medal <> 'No medal') AS medals FROM rv GROUP BY sport""")
def flagged(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).withColumn("flag", flag("medal", NO_MEDAL))
    return rows.groupBy("sport").agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("medals"))


@query("pf20_flag_label", """
SELECT CASE WHEN medal = 'No medal' THEN 'No medal' ELSE 'Medal' END AS label, count(*) AS n FROM rv GROUP BY 1""")
def flag_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).withColumn("flag", flag("medal", NO_MEDAL))
    return count_by(rows.withColumn("label", unflag("flag", "Medal", NO_MEDAL)), ["label"])


@query("pf21_relabel", """
SELECT 'kept' AS mode, CASE WHEN team = 'NATION_3-1' THEN 'NATION_3' ELSE team END AS team, sport, medals FROM counts
UNION ALL
SELECT 'merged', CASE WHEN team = 'NATION_3-1' THEN 'NATION_3' ELSE team END, sport, CAST(sum(medals) AS BIGINT)
FROM counts GROUP BY 2, 3""",
       "counts AS (SELECT team, sport, count(*) AS medals FROM rv WHERE medal <> 'No medal' GROUP BY team, sport)")
def relabelled_teams(spark: SparkSession, folder: str) -> DataFrame:
    names = {"NATION_3-1": "NATION_3"}
    rows = participation(spark, folder).filter(won())
    kept = count_by(rows, ["team", "sport"], target="medals").withColumn("team", recode("team", names))
    merged = count_by(rows.withColumn("team", recode("team", names)), ["team", "sport"], target="medals")
    return kept.withColumn("mode", F.lit("kept")).unionByName(merged.withColumn("mode", F.lit("merged")))


@query("pf22_constant", "SELECT 'AM' AS continent, century, count(*) AS n FROM rv GROUP BY century")
def constant_column(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).withColumn("continent", F.lit(DEFAULT_CODE))
    return count_by(rows, ["continent", "century"])


@query("pf23_project", "SELECT DISTINCT name, sex, sport, season FROM rv WHERE medal = 'Gold'")
def projected(spark: SparkSession, folder: str) -> DataFrame:
    golds = participation(spark, folder).filter(F.col("medal") == "Gold")
    return golds.select("season", "sport", "name", "sex").distinct()


@query("pf24_drop_columns", """
SELECT continent, season, medal, age_bin, CAST(sum(medals) AS BIGINT) AS medals FROM (
  SELECT continent, season, medal, sex, age_bin, count(*) AS medals FROM rv WHERE medal <> 'No medal' GROUP BY ALL) GROUP BY ALL""")
def without_sex(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["continent", "season", "medal", "sex", "age_bin"]
    groups = count_by(participation(spark, folder).filter(won()), keys, target="medals").drop("sex")
    return groups.groupBy(*[c for c in groups.columns if c != "medals"]).agg(F.sum("medals").alias("medals"))


@query("pf25_rename", "SELECT sport AS discipline, count(*) AS entries FROM rv GROUP BY sport")
def renamed(spark: SparkSession, folder: str) -> DataFrame:
    counts = count_by(participation(spark, folder), ["sport"])
    return counts.withColumnsRenamed({"sport": "discipline", "n": "entries"})


@query("pf26_insert_column", """
SELECT age, CASE WHEN age < 30 THEN 'under 30' ELSE '30 and over' END AS age_class, sport, count(*) AS n
FROM rv GROUP BY ALL""")
def inserted(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("age") < 30, F.lit("under 30")).otherwise(F.lit("30 and over"))
    rows = insert_after(participation(spark, folder).select("age", "sport"), "age", "age_class", label)
    return count_by(rows, rows.columns)


@query("pf27_cast", """
SELECT CAST(split_part(games, ' ', 1) AS INTEGER) AS year, CAST(TRY_CAST(split_part(games, ' ', 2) AS INTEGER) AS VARCHAR) AS text,
  CAST(CAST(max(age) AS INTEGER) AS VARCHAR) AS oldest FROM raw GROUP BY 1, 2""")
def cast_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw_participation(spark, folder).withColumns({
        "year": word("games", 0).cast("int"),
        "text": word("games", 1).try_cast("int").cast("string"),
    })
    return rows.groupBy("year", "text").agg(F.max("age").cast("int").cast("string").alias("oldest"))


@query("pf28_arithmetic", """
SELECT sport, gold + silver + bronze AS total, gold - bronze AS lead, round(gold / (gold + silver + bronze), 6) AS gold_share,
  round(pow(gold / 10.0, 2), 6) AS squared
FROM (SELECT sport, count(*) FILTER (WHERE medal = 'Gold') AS gold, count(*) FILTER (WHERE medal = 'Silver') AS silver, count(*) FILTER (WHERE medal = 'Bronze') AS bronze
      FROM rv GROUP BY sport)""")
def arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    pivot = category_pivot(participation(spark, folder), ["sport"])
    return pivot.select(
        "sport",
        (F.col("gold") + F.col("silver") + F.col("bronze")).alias("total"),
        (F.col("gold") - F.col("bronze")).alias("lead"),
        F.round(F.col("gold") / F.col("total"), 6).alias("gold_share"),
        F.round(F.pow(F.col("gold") / 10, F.lit(2)), 6).alias("squared"),
    )


# Scalar functions


@query("fn01_split", """
SELECT split_part(games, ' ', 1) AS first_word, split_part(games, ' ', 2) AS second_word, count(*) AS n FROM raw GROUP BY 1, 2""")
def split_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw_participation(spark, folder)
    return count_by(rows.select(word("games", 0).alias("first_word"), word("games", 1).alias("second_word")),
                    ["first_word", "second_word"])


@query("fn02_decorated_label", "SELECT age_bin || ' (' || sex || ')' AS label, count(*) AS n FROM rv GROUP BY 1")
def decorated_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).select(decorated(F.col("age_bin"), F.col("sex")).alias("label"))
    return count_by(rows, ["label"])


@query("fn03_parse_label", """
SELECT DISTINCT age_bin, CAST(split_part(age_bin, '-', 1) AS INTEGER) AS lo, CAST(split_part(age_bin, '-', 2) AS INTEGER) AS hi FROM rv""")
def parsed_labels(spark: SparkSession, folder: str) -> DataFrame:
    lo, hi = label_bounds(F.col("age_bin"))
    return participation(spark, folder).select("age_bin").distinct().select("age_bin", lo.alias("lo"), hi.alias("hi"))


@query("fn04_build_label", """
SELECT CAST(CAST(floor(age / 5) * 5 + 1 AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(floor(age / 5) * 5 + 5 AS INTEGER) AS VARCHAR) AS label,
  count(*) AS n FROM rv GROUP BY 1""")
def built_labels(spark: SparkSession, folder: str) -> DataFrame:
    low = F.floor(F.col("age") / 5) * 5
    return count_by(participation(spark, folder).select(bounds_label(low + 1, low + 5).alias("label")), ["label"])


@query("fn06_round", f"""
SELECT sport, {half_up("avg(age)")} AS half_up, round_even(avg(age) * 100, 0) / 100 AS half_even FROM rv GROUP BY sport""")
def rounded(spark: SparkSession, folder: str) -> DataFrame:
    mean = F.avg("age")
    return participation(spark, folder).groupBy("sport").agg(
        F.round(mean, 2).alias("half_up"), round_even(mean, 2).alias("half_even")
    )


@query("fn07_floor", "SELECT sport, year, CAST(floor(avg(age)) AS BIGINT) AS floor_age FROM rv GROUP BY sport, year")
def floored(spark: SparkSession, folder: str) -> DataFrame:
    return participation(spark, folder).groupBy("sport", "year").agg(F.floor(F.avg("age")).alias("floor_age"))


@query("fn08_body_mass_index", """
SELECT sport, round(min(weight / pow(height / 100, 2)), 6) AS lowest, round(max(weight / pow(height / 100, 2)), 6) AS highest
FROM rv GROUP BY sport""")
def body_mass(spark: SparkSession, folder: str) -> DataFrame:
    bmi = body_mass_index("weight", "height")
    return participation(spark, folder).groupBy("sport").agg(
        F.round(F.min(bmi), 6).alias("lowest"), F.round(F.max(bmi), 6).alias("highest")
    )


@query("fn09_cyclic_year", """
SELECT year, n, round(sin(2 * pi() * year / top), 6) AS year_sin, round(cos(2 * pi() * year / top), 6) AS year_cos
FROM (SELECT year, count(*) AS n FROM rv GROUP BY year), (SELECT max(year) AS top FROM rv)""")
def cyclic_years(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_cyclic_year(count_by(participation(spark, folder), ["year"]))
    return rows.withColumns({c: F.round(c, 6) for c in ("year_sin", "year_cos")})


@query("fn10_predicates", """
SELECT sport, count(*) FILTER (WHERE height IS NULL) AS unknown, count(*) FILTER (WHERE height IS NOT NULL) AS known, count(*) FILTER (WHERE age BETWEEN 20 AND 25) AS twenties,
  count(*) FILTER (WHERE event IN ('Brand#1', 'Brand#2')) AS listed,
  CAST(sum(CASE WHEN height IS NULL THEN 0 WHEN height < 175 THEN 1 ELSE 2 END) AS BIGINT) AS score FROM rv GROUP BY sport""")
def predicates(spark: SparkSession, folder: str) -> DataFrame:
    height = F.col("height")
    score = F.when(height.isNull(), F.lit(0)).when(height < 175, F.lit(1)).otherwise(F.lit(2))
    return participation(spark, folder).groupBy("sport").agg(
        F.count_if(height.isNull()).alias("unknown"),
        F.count_if(height.isNotNull()).alias("known"),
        F.count_if(F.col("age").between(20, 25)).alias("twenties"),
        F.count_if(F.col("event").isin("Brand#1", "Brand#2")).alias("listed"),
        F.sum(score).alias("score"),
    )


@query("fn11_fill_constant", "SELECT sport, sum(coalesce(height, 0)) AS height, count(*) AS n FROM rv GROUP BY sport")
def filled_constant(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).fillna(0, ["height"])
    return rows.groupBy("sport").agg(F.sum("height").alias("height"), F.count(F.lit(1)).alias("n"))


@query("fn12_year_start", "SELECT make_date(year, 1, 1) AS ds, count(*) AS n FROM rv GROUP BY 1")
def year_starts(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(participation(spark, folder).select(new_year("year").alias("ds")), ["ds"])


@query("fn13_horizon", """
SELECT sport, 'step' AS kind, last + 2 * i AS year FROM (SELECT sport, max(year) AS last FROM rv GROUP BY sport), (SELECT unnest(range(1, 11)) AS i)
UNION ALL SELECT DISTINCT sport, 'list', y FROM rv, (SELECT unnest([2020, 2024, 2028, 2032, 2036]) AS y)""")
def horizons(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder)
    steps = horizon(rows, "year", 10, 2, ["sport"]).withColumn("kind", F.lit("step"))
    listed = fixed_horizon(rows, "year", [2020, 2024, 2028, 2032, 2036], ["sport"]).withColumn("kind", F.lit("list"))
    return steps.unionByName(listed).withColumn("year", F.col("year").cast("bigint"))


@query("fn14_equal_edges", """
SELECT CAST(i AS INTEGER) AS position, CASE WHEN i = 8 THEN hi ELSE round_even((lo + (hi - lo) / 8 * i) * 100, 0) / 100 END AS edge
FROM (SELECT min(weight) AS lo, max(weight) AS hi FROM rv), (SELECT unnest(range(0, 9)) AS i)""")
def equal_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = equal_width_edges(participation(spark, folder), "weight")
    return edges.select(F.posexplode("edges").alias("position", "edge"))


@query("fn15_first_seen_index", """
SELECT sport, row_number() OVER (ORDER BY y, e, sport) - 1 AS sport_at
FROM (SELECT sport, min(year) AS y, min_by(event, (year, event)) AS e FROM rv GROUP BY sport)""")
def first_seen(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).select("sport", "year", "event")
    return first_seen_index(rows, {"sport": "sport_at"}, ["year", "event"]).select("sport", "sport_at").distinct()


@query("fn16_century", """
SELECT year, CASE WHEN year BETWEEN 1801 AND 1900 THEN 19 WHEN year BETWEEN 1901 AND 2000 THEN 20 WHEN year BETWEEN 2001 AND 2100 THEN 21 END AS century,
  count(*) AS n FROM (SELECT CAST(split_part(games, ' ', 1) AS INTEGER) AS year FROM raw) GROUP BY 1, 2""")
def centuries(spark: SparkSession, folder: str) -> DataFrame:
    years = raw_participation(spark, folder).select(word("games", 0).cast("int").alias("year"))
    return count_by(years, ["year"]).withColumn("century", century("year"))


# Bins


@query("bn01_fixed_bins", """
SELECT CASE WHEN age >= 0 AND age < 20 THEN '1-20' WHEN age < 25 THEN '21-25' WHEN age < 30 THEN '26-30' WHEN age < 40 THEN '31-40'
  WHEN age < 60 THEN '41-60' END AS age_bin, count(*) AS n, min(age) AS youngest, max(age) AS oldest FROM raw GROUP BY 1""")
def fixed_age_bins(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw_participation(spark, folder).select("age", age_bin("age").alias("age_bin"))
    return rows.groupBy("age_bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("age").alias("youngest"), F.max("age").alias("oldest")
    )


@query("bn02_equal_width_bins", "SELECT bmi_bin, count(*) AS n FROM binned GROUP BY bmi_bin",
       f"bodies AS (SELECT {BMI} AS bmi FROM rv WHERE {BMI} BETWEEN 18.5 AND 35)", *equal_width("bodies"))
def equal_bins(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).select(F.round(body_mass_index("weight", "height"), 2).alias("bmi"))
    return count_by(equal_width_bins(rows.filter(F.col("bmi").between(18.5, 35.0)), "bmi", "bmi_bin"), ["bmi_bin"])


@query("bn03_right_closed_bins", """
SELECT CASE WHEN age > 0 AND age <= 20 THEN '1-20' WHEN age <= 30 THEN '21-30' WHEN age <= 40 THEN '31-40' WHEN age <= 50 THEN '41-50'
  WHEN age <= 60 THEN '51-60' WHEN age <= 70 THEN '61-70' END AS age_group, count(*) AS n FROM raw GROUP BY 1""")
def decade_age_bins(spark: SparkSession, folder: str) -> DataFrame:
    return count_by(raw_participation(spark, folder).select(decade_bin("age").alias("age_group")), ["age_group"])


@query("bn04_label_of_mean", f"""
SELECT year, sport, sex, mean_age, CASE WHEN floor(mean_age) BETWEEN 1 AND 20 THEN '1-20' WHEN floor(mean_age) BETWEEN 21 AND 25 THEN '21-25'
  WHEN floor(mean_age) BETWEEN 26 AND 30 THEN '26-30' WHEN floor(mean_age) BETWEEN 31 AND 40 THEN '31-40'
  WHEN floor(mean_age) BETWEEN 41 AND 60 THEN '41-60' END AS age_bin
FROM (SELECT year, sport, sex, {half_up('avg(age)')} AS mean_age FROM rv GROUP BY year, sport, sex)""")
def label_of_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder)
    means = rows.groupBy("year", "sport", "sex").agg(F.round(F.avg("age"), 2).alias("mean_age"))
    return range_label(means, "mean_age", rows.select("age_bin").distinct(), "age_bin", "age_bin")


# Imputation


MEASURES_SQL = (
    """h AS (SELECT rv.*, coalesce(height, avg(height) OVER (PARTITION BY sport)) AS h1 FROM rv)""",
    """w AS (SELECT *, coalesce(weight, avg(weight) OVER (PARTITION BY sport, h1)) AS w1 FROM h)""",
    """filled AS (SELECT * REPLACE (h1 AS height, coalesce(w1, avg(w1) OVER (PARTITION BY sport)) AS weight)
  FROM w)""",
)


@query("im01_three_stage", """
SELECT sport, count(*) AS n, round(avg(height), 6) AS mean_height, round(avg(weight), 6) AS mean_weight,
  round(min(weight), 6) AS lightest, round(max(weight), 6) AS heaviest
FROM filled WHERE height IS NOT NULL AND weight IS NOT NULL GROUP BY sport""", *MEASURES_SQL)
def three_stage(spark: SparkSession, folder: str) -> DataFrame:
    return fill_body_measures(participation(spark, folder)).groupBy("sport").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("height"), 6).alias("mean_height"),
        F.round(F.avg("weight"), 6).alias("mean_weight"),
        F.round(F.min("weight"), 6).alias("lightest"),
        F.round(F.max("weight"), 6).alias("heaviest"),
    )


@query("im02_group_mean_fill", """
SELECT sport, medal, round(avg(h), 6) AS mean_height, round(avg(w), 6) AS mean_weight FROM (
  SELECT sport, medal, coalesce(height, avg(height) OVER (PARTITION BY sport)) AS h,
    coalesce(weight, avg(weight) OVER (PARTITION BY sport)) AS w FROM rv) GROUP BY sport, medal""")
def group_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill_with_group_mean(participation(spark, folder), ["height", "weight"], "sport").groupBy("sport", "medal").agg(
        F.round(F.avg("height"), 6).alias("mean_height"), F.round(F.avg("weight"), 6).alias("mean_weight")
    )


@query("im03_future_covariates", """
SELECT season, continent, round(avg(athletes), 6) AS athletes, round(avg(mean_age), 6) AS mean_age FROM (
  SELECT year, season, continent, count(DISTINCT id) AS athletes, avg(age) AS mean_age FROM rv GROUP BY ALL) GROUP BY ALL""")
def future_covariates(spark: SparkSession, folder: str) -> DataFrame:
    return yearly_profile(participation(spark, folder)).groupBy("season", "continent").agg(
        F.round(F.avg("athletes"), 6).alias("athletes"), F.round(F.avg("mean_age"), 6).alias("mean_age")
    )


# Encodings


@query("en01_label_index", """
SELECT sport, event, s AS sport_index, e AS event_index, n FROM (SELECT sport, event, count(*) AS n FROM rv GROUP BY ALL)
JOIN (SELECT sport, row_number() OVER (ORDER BY sport) - 1 AS s FROM (SELECT DISTINCT sport FROM rv)) USING (sport)
JOIN (SELECT event, row_number() OVER (ORDER BY event) - 1 AS e FROM (SELECT DISTINCT event FROM rv)) USING (event)""")
def label_indices(spark: SparkSession, folder: str) -> DataFrame:
    rows = label_index(participation(spark, folder).select("sport", "event"), {"sport": "sport_index", "event": "event_index"})
    return count_by(rows, ["sport", "event", "sport_index", "event_index"])


@query("en02_standardise", """
SELECT sport, round(sum((age - m) / s) / count(*), 6) AS mean_age_z, round(max((age - m) / s), 6) AS top_age_z
FROM rv, (SELECT avg(age) AS m, stddev_pop(age) AS s FROM rv) GROUP BY sport""")
def standardised(spark: SparkSession, folder: str) -> DataFrame:
    return standardise(participation(spark, folder), ["age"]).groupBy("sport").agg(
        F.round(F.sum("age_z") / F.count(F.lit(1)), 6).alias("mean_age_z"), F.round(F.max("age_z"), 6).alias("top_age_z")
    )


@query("en03_feature_matrix", """
SELECT label, count(*) AS n, sum(height) AS height, sum(weight) AS weight, sum(age) AS age FROM (
  SELECT CASE WHEN medal = 'No medal' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label, height, weight, age FROM rv
  WHERE height IS NOT NULL AND weight IS NOT NULL) GROUP BY label""")
def feature_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows = participation(spark, folder).withColumn("won", flag("medal", NO_MEDAL)).select("height", "weight", "age", "won")
    matrix = features(rows, ["height", "weight", "age"], "won").select("label", vector_to_array("features").alias("x"))
    return matrix.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col("x")[i]).alias(c) for i, c in enumerate(("height", "weight", "age"))],
    )
