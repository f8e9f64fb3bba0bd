"""Model jobs. Autoregressions of low order, their folds and the design of trends have SQL; of the other models the keys,
covariates and counts have, beside invariants and plain least squares in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palmares.catalog.registry import ROLES, query
from palmares.catalog.scenario import BODY_SQL
from palmares.models.classify import FOREST_INPUTS, TREE_INPUTS, fit_classifier, forest, labelled_profiles, score, tree
from palmares.models.forecast import SERIES as PACKED, Autoregression, TrendAndSeason, boosted_trees, pooled_forecast, random_forest
from palmares.operators.aggregates import count_by
from palmares.operators.metrics import binary_metrics, class_report
from palmares.operators.sampling import exact_sample, exact_samples, split
from palmares.operators.series import fixed_horizon, future_rows, history_with_future, horizon
from palmares.plans.ages import mean_ages
from palmares.plans.bodies import GROUPS, body_groups, country_bodies
from palmares.plans.doubles import achievement_series, cohort
from palmares.plans.medals import yearly_features
from palmares.plans.roles import participation
from palmares.schemas import FORECAST_YEARS
from palmares.sources.files import table
from palmares.sources.models import load_model, save_model
from palmares.store import new_path, stored, stored_once

MEDAL_INPUTS = ("year", "year_sin", "year_cos", "athletes", "mean_age")
PROFILE_KEYS = [c for c in GROUPS if c not in ("age_bin", "bmi_bin")]


SERIES = ("season", "continent")


#: Boosted trees of the registered queries: each is a few Spark jobs, so they are fewer and take larger steps.
TREES, RATE = 20, 0.3


def boosted_forecast(profile: DataFrame) -> DataFrame:
    ahead = pooled_forecast(profile, future_rows(profile), SERIES, MEDAL_INPUTS, "medals", boosted_trees(TREES, rate=RATE))
    return ahead.select(*SERIES, "year", "athletes", "mean_age", "yhat")


def forest_forecast(profile: DataFrame) -> DataFrame:
    ahead = pooled_forecast(profile, future_rows(profile), SERIES, MEDAL_INPUTS, "medals", random_forest())
    return ahead.select(*SERIES, "year", "athletes", "mean_age", "yhat")


def ar_forecast(profile: DataFrame, lags: int = 5) -> DataFrame:
    rows = history_with_future(profile.select(*SERIES, "year", "medals"), fixed_horizon(profile, "year", FORECAST_YEARS, SERIES))
    return Autoregression(lags).forecast(rows, SERIES, "year", "medals")


def profile_of(spark: SparkSession, folder: str) -> DataFrame:
    return stored_once(spark, (folder, "yearly-profile"), lambda: yearly_features(participation(spark, folder)))


@query("ml05_boosted_trees")
def boosted(spark: SparkSession, folder: str) -> DataFrame:
    return boosted_forecast(profile_of(spark, folder))


@query("ml06_random_forest")
def forested(spark: SparkSession, folder: str) -> DataFrame:
    return forest_forecast(profile_of(spark, folder))


HORIZON_SQL = """
SELECT season, continent, CAST(y AS INTEGER) AS year, round(athletes, 6) AS athletes, round(mean_age, 6) AS mean_age, true AS predicted FROM (
  SELECT season, continent, avg(athletes) AS athletes, avg(mean_age) AS mean_age FROM (
    SELECT year, season, continent, count(DISTINCT id) AS athletes, avg(age) AS mean_age FROM rv GROUP BY ALL) GROUP BY ALL),
  (SELECT unnest([2020, 2024, 2028, 2032, 2036]) AS y)"""


def horizon_of(ahead: DataFrame) -> DataFrame:
    """What a forecast must cover: its keys, the covariates it was made from, and whether there is a value."""
    rounded = [F.round(c, 6).alias(c) for c in ("athletes", "mean_age")]
    return ahead.select(*SERIES, "year", *rounded, (F.col("yhat").isNotNull() & ~F.isnan("yhat")).alias("predicted"))


@query("ml05_horizon", HORIZON_SQL)
def boosted_horizon(spark: SparkSession, folder: str) -> DataFrame:
    return horizon_of(boosted(spark, folder))


@query("ml06_horizon", HORIZON_SQL)
def forested_horizon(spark: SparkSession, folder: str) -> DataFrame:
    return horizon_of(forested(spark, folder))


@query("ml07_age_forest")
def age_forest(spark: SparkSession, folder: str) -> DataFrame:
    ages = mean_ages(participation(spark, folder), all_years=True).filter(F.col("season") == "Summer")
    ages = split(stored(ages, "ages"), ["year", "sport", "sex"], 80)
    train = ages.filter(F.col("part") == "train")
    return pooled_forecast(
        train, fixed_horizon(ages, "year", FORECAST_YEARS, ["sex"]), ["sex"], ["year"], "mean_age", random_forest(100)
    )


@query("ml07_horizon", "SELECT DISTINCT sex, CAST(y AS INTEGER) AS year, true AS predicted FROM rv, (SELECT unnest([2020, 2024, 2028, 2032, 2036]) AS y)")
def age_horizon(spark: SparkSession, folder: str) -> DataFrame:
    return age_forest(spark, folder).select("sex", "year", F.col("yhat").between(0, 100).alias("predicted"))


def yearly_medals(spark: SparkSession, folder: str) -> DataFrame:
    medals = participation(spark, folder).filter(F.col("medal") != "No medal")
    return count_by(medals, ["season", "continent", "year"], target="medals")


@query("ml08_autoregression")
def autoregressed(spark: SparkSession, folder: str) -> DataFrame:
    return ar_forecast(yearly_medals(spark, folder))


def ar_sql(series: str, keys: str, coefficients: str, horizon: str) -> str:
    """Recursive SQL for an autoregression of order 1 or 2 on first differences: ``series`` gives (keys, t, v)."""
    return f"""
series AS ({series}),
steps AS (SELECT *, v - lag(v) OVER w AS x, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY {keys}) AS n FROM series WINDOW w AS (PARTITION BY {keys} ORDER BY t)),
lags AS (SELECT *, lag(x, 1) OVER w AS a, lag(x, 2) OVER w AS b FROM steps WINDOW w AS (PARTITION BY {keys} ORDER BY t)),
coef AS ({coefficients}),
walk AS (
  SELECT {keys}, fold, 0 AS step, v AS level, x AS x1, a AS x2 FROM lags JOIN coef USING ({keys}) WHERE pos = train - 1
  UNION ALL
  SELECT {keys}, fold, step + 1, level + f1 * x1 + f2 * coalesce(x2, 0), f1 * x1 + f2 * coalesce(x2, 0), x1 FROM walk JOIN coef USING ({keys}, fold) WHERE step < {horizon}
)"""


MEDAL_SERIES = "SELECT season, continent, year AS t, CAST(count(*) AS DOUBLE) AS v FROM rv WHERE medal <> 'No medal' GROUP BY ALL"
#: Normal equations of order 1 and 2 over whole series.
FIRST_ORDER = "SELECT season, continent, 0 AS fold, any_value(n) AS train, sum(x * a) / sum(a * a) AS f1, 0.0 AS f2 FROM lags WHERE a IS NOT NULL GROUP BY ALL"
SECOND_ORDER = """SELECT season, continent, 0 AS fold, n AS train, (xa * bb - xb * ab) / (aa * bb - ab * ab) AS f1, (xb * aa - xa * ab) / (aa * bb - ab * ab) AS f2 FROM (
    SELECT season, continent, any_value(n) AS n, sum(x * a) AS xa, sum(x * b) AS xb, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM lags WHERE b IS NOT NULL GROUP BY ALL)"""


def order_sql(coefficients: str) -> str:
    return f"""WITH RECURSIVE {ROLES}, {ar_sql(MEDAL_SERIES, 'season, continent', coefficients, '5')}
SELECT season, continent, CAST(2016 + 4 * step AS INTEGER) AS year, round(level, 4) AS yhat, 'ok' AS status FROM walk WHERE step > 0"""


@query("ml08_first_order", order_sql(FIRST_ORDER), roles=False)
def first_order(spark: SparkSession, folder: str) -> DataFrame:
    return ar_forecast(yearly_medals(spark, folder), 1).withColumn("yhat", F.round("yhat", 4))


@query("ml08_second_order", order_sql(SECOND_ORDER), roles=False)
def second_order(spark: SparkSession, folder: str) -> DataFrame:
    return ar_forecast(yearly_medals(spark, folder), 2).withColumn("yhat", F.round("yhat", 4))


def monthly_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per priority and month: series long enough for five lags."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month")
    return count_by(table(spark, folder, "orders").select("o_orderpriority", month), ["o_orderpriority", "month"])


MONTHS_SQL = """SELECT o_orderpriority, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS t, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL"""


@query("ml08_monthly_orders")
def monthly_autoregression(spark: SparkSession, folder: str) -> DataFrame:
    """Five lags, a year ahead, with the fitted values of the history."""
    series = monthly_orders(spark, folder)
    rows = history_with_future(series, horizon(series, "month", 12, 1, ["o_orderpriority"]))
    return Autoregression(5).forecast(rows, ["o_orderpriority"], "month", "n", fitted=True)


@query("ml08_monthly_rows", f"""
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY t) - 1 AS pos FROM ({MONTHS_SQL}))
SELECT o_orderpriority, t AS month, pos >= 6 AS predicted FROM numbered
UNION ALL SELECT o_orderpriority, CAST(max(t) + i AS INTEGER), true FROM numbered, range(1, 13) AS r(i) GROUP BY o_orderpriority, i""", roles=False)
def monthly_rows(spark: SparkSession, folder: str) -> DataFrame:
    """History and horizon, and whether each row has a fitted or forecast value: all but those without five lags."""
    return monthly_autoregression(spark, folder).select("o_orderpriority", "month", F.col("yhat").isNotNull().alias("predicted"))


@query("ml09_trend_and_season")
def trended(spark: SparkSession, folder: str) -> DataFrame:
    history = yearly_medals(spark, folder)
    rows = history_with_future(history, horizon(history, "year", 10, 2, SERIES))
    return TrendAndSeason().forecast(rows, SERIES, "year", "medals")


@query("ml09_design_matrix", """
SELECT season, continent, year, CAST(term AS INTEGER) AS term, round(x, 6) AS x FROM (
  SELECT season, continent, year, unnest(range(9)) AS term, unnest([1.0::DOUBLE, (year - low) / span] ||
    list_transform(range(1, 4), lambda j: greatest(year - knots[j], 0) / span) ||
    [sin(2 * pi() * year), cos(2 * pi() * year), sin(4 * pi() * year), cos(4 * pi() * year)]) AS x
  FROM yearly JOIN (SELECT season, continent, min(year) AS low, greatest(max(year) - min(year), 1) AS span,
    quantile_cont(year, [0.8 / 3, 1.6 / 3, 0.8]) AS knots FROM yearly GROUP BY ALL) USING (season, continent))""",
       "yearly AS (SELECT season, continent, year FROM rv WHERE medal <> 'No medal' GROUP BY ALL)")
def trend_design(spark: SparkSession, folder: str) -> DataFrame:
    """The inputs of the trend model with three bends and two waves, term by term."""
    model = TrendAndSeason(bends=3, waves=2)
    series = yearly_medals(spark, folder).select(F.struct(*SERIES).alias(PACKED), "year")
    shaped = series.join(model.shapes(stored(series, "series"), "year"), PACKED)
    rows = shaped.select(f"{PACKED}.*", "year", F.posexplode(model.design("year")).alias("term", "x"))
    return rows.withColumn("x", F.round("x", 6) + 0.0)


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled profiles of one country, made once a session for all classifiers."""

    def build() -> DataFrame:
        bodies = country_bodies(participation(spark, folder), "NATION_3")
        return labelled_profiles(body_groups(bodies, medals_only=False, keys=PROFILE_KEYS))

    return stored_once(spark, (folder, "country-profiles"), build)


#: Profiles of the country with all outcomes, and their side of a split by the hash of their keys.
PROFILE_SQL = (
    *BODY_SQL[:-1],
    """counted AS (SELECT team, sport, sex, height, weight, age, bmi, medal, count(*) AS medals FROM binned WHERE year >= 1945 GROUP BY ALL)""",
    """hashed AS (SELECT *, CASE medal WHEN 'No medal' THEN 0 ELSE 1 END AS actual, CAST('0x' || substr(md5(concat_ws('|', '42', team, sport, sex,
  CAST(height AS DECIMAL(24, 6)), CAST(weight AS DECIMAL(24, 6)), CAST(age AS DECIMAL(24, 6)), CAST(bmi AS DECIMAL(24, 6)), medal)), 1, 15) AS BIGINT) % 100 AS place FROM counted)""",
)


@query("ml10_forest_classifier")
def classified(spark: SparkSession, folder: str) -> DataFrame:
    rows = split(profiles(spark, folder), PROFILE_KEYS, 10)
    model = fit_classifier(rows.filter(F.col("part") == "train"), forest(), FOREST_INPUTS)
    return binary_metrics(score(model, rows.filter(F.col("part") == "test")), "actual", "predicted")


@query("ml11_tree_classifier")
def tree_classified(spark: SparkSession, folder: str) -> DataFrame:
    rows = split(profiles(spark, folder), PROFILE_KEYS, 80)
    model = fit_classifier(rows.filter(F.col("part") == "train"), tree(), TREE_INPUTS)
    return class_report(score(model, rows.filter(F.col("part") == "test")), "actual", "predicted")


@query("ml11_support", """
SELECT CAST(actual AS VARCHAR) AS class, count(*) AS support FROM hashed WHERE place >= 80 GROUP BY 1
UNION ALL SELECT c, (SELECT count(*) FROM hashed WHERE place >= 80) FROM (SELECT unnest(['macro avg', 'weighted avg']) AS c)""", *PROFILE_SQL)
def tree_support(spark: SparkSession, folder: str) -> DataFrame:
    """The classes of the report of the tree and how many rows each has."""
    return tree_classified(spark, folder).select("class", "support")


@query("ml10_rows", "SELECT count(*) AS n FROM hashed WHERE place >= 10", *PROFILE_SQL)
def classified_rows(spark: SparkSession, folder: str) -> DataFrame:
    return classified(spark, folder).select("n")


@query("ml12_batch_scoring")
def scored_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows, path = profiles(spark, folder), new_path(spark, "model")
    train = split(rows, PROFILE_KEYS, 10).filter(F.col("part") == "train")
    save_model(fit_classifier(train, forest(), FOREST_INPUTS), path)
    return score(load_model(path), exact_sample(rows, PROFILE_KEYS, 20))


@query("ml12_scored_rows", "SELECT (count(*) * 20) // 100 AS n, (count(*) * 20) // 100 AS n_scored, (count(*) * 20) // 100 AS n_profiles FROM hashed", *PROFILE_SQL)
def scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the sample, those with a prediction, and the different profiles among them."""
    rows = scored_sample(spark, folder)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("predicted_name").alias("n_scored"), F.countDistinct(*PROFILE_KEYS).alias("n_profiles"))


@query("io16_model_round_trip", "SELECT count(*) AS n, count(*) AS n_same FROM hashed", *PROFILE_SQL)
def model_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Rows scored, and rows on which the saved and the reloaded model agree."""
    rows, path = profiles(spark, folder), new_path(spark, "model")
    model = fit_classifier(rows, tree(), TREE_INPUTS)
    save_model(model, path)
    again = score(load_model(path), score(model, rows).withColumnRenamed("predicted", "before").drop("actual_name", "predicted_name"))
    return again.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before").eqNullSafe(F.col("predicted"))).alias("n_same"))


@query("ml16_per_series_validation")
def validated(spark: SparkSession, folder: str) -> DataFrame:
    series = stored(yearly_medals(spark, folder), "series")
    ar = Autoregression().validate(series, SERIES, "year", "medals").withColumn("model", F.lit("autoregression"))
    trend = TrendAndSeason().validate(series, SERIES, "year", "medals").withColumn("model", F.lit("trend"))
    return ar.unionByName(trend)


FOLDS_OF_ORDER_1 = """SELECT o_orderpriority, fold, CAST(n - (6 - fold) * (n // 6) AS BIGINT) AS train, n // 6 AS size, 0.0 AS f2,
    coalesce(sum(x * a) FILTER (WHERE pos < n - (6 - fold) * (n // 6)) / sum(a * a) FILTER (WHERE pos < n - (6 - fold) * (n // 6)), 0) AS f1
  FROM lags, (SELECT unnest([1, 2, 3, 4, 5]) AS fold) GROUP BY o_orderpriority, fold, n"""


@query("ml16_first_order_folds", f"""WITH RECURSIVE {ar_sql(MONTHS_SQL, 'o_orderpriority', FOLDS_OF_ORDER_1, 'size')}
SELECT o_orderpriority, CAST(fold AS INTEGER) AS fold, 'ok' AS status, round(avg(abs(v - level)), 4) AS mae
FROM walk JOIN coef USING (o_orderpriority, fold) JOIN steps USING (o_orderpriority) WHERE step > 0 AND pos = train + step - 1 GROUP BY ALL""", roles=False)
def monthly_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of a first-order autoregression in five folds of every series, all from one pass."""
    errors = Autoregression(1).validate(monthly_orders(spark, folder), ["o_orderpriority"], "month", "n")
    return errors.withColumn("mae", F.round("mae", 4))


@query("q1e_medal_forecast")
def medal_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """History and forecasts of three models per season and continent."""
    profile = profile_of(spark, folder)
    forecasts = {
        "boosted trees": boosted_forecast(profile),
        "random forest": forest_forecast(profile),
        "autoregression": ar_forecast(profile),
    }
    rows = profile.select(*SERIES, "year", F.col("medals").cast("double").alias("medals"), F.lit("history").alias("model"))
    for name, part in forecasts.items():
        rows = rows.unionByName(part.select(*SERIES, "year", F.col("yhat").alias("medals"), F.lit(name).alias("model")))
    return rows


@query("q1e_forecast_keys", """
SELECT season, continent, year, model, medals FROM (
  SELECT season, continent, year, 'history' AS model, count(*) FILTER (WHERE medal <> 'No medal') AS medals FROM rv GROUP BY ALL
  UNION ALL SELECT DISTINCT season, continent, CAST(y AS INTEGER), model, CAST(NULL AS BIGINT) FROM rv, (SELECT unnest([2020, 2024, 2028, 2032, 2036]) AS y),
    (SELECT unnest(['boosted trees', 'random forest', 'autoregression']) AS model))""")
def forecast_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the forecast with the medals of the history; every forecast must have a value."""
    rows = medal_forecasts(spark, folder).filter(F.col("medals").isNotNull())
    return rows.withColumn("medals", F.when(F.col("model") == "history", F.col("medals").cast("long")))


@query("q2e_age_forecast")
def age_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Mean medallist age per sex ahead: forest over all series and autoregression of the yearly mean."""
    ages = stored(mean_ages(participation(spark, folder), all_years=True).filter(F.col("season") == "Summer"), "ages")
    train = split(ages, ["year", "sport", "sex"], 80).filter(F.col("part") == "train")
    ahead = fixed_horizon(ages, "year", FORECAST_YEARS, ["sex"])
    forest_part = pooled_forecast(train, ahead, ["sex"], ["year"], "mean_age", random_forest(100))
    yearly = ages.groupBy("sex", "year").agg(F.avg("mean_age").alias("mean_age"))
    ar = Autoregression().forecast(history_with_future(yearly, ahead), ["sex"], "year", "mean_age")
    forest_part = forest_part.withColumns({"model": F.lit("random forest"), "status": F.lit("ok")})
    return forest_part.unionByName(ar.withColumn("model", F.lit("autoregression")))


@query("q2e_forecast_keys", """
SELECT DISTINCT sex, CAST(y AS INTEGER) AS year, model, true AS predicted FROM rv, (SELECT unnest([2020, 2024, 2028, 2032, 2036]) AS y),
  (SELECT unnest(['random forest', 'autoregression']) AS model)""")
def age_forecast_keys(spark: SparkSession, folder: str) -> DataFrame:
    return age_forecasts(spark, folder).select("sex", "year", "model", F.col("yhat").between(0, 120).alias("predicted"))


@query("q3d_medal_classifier")
def medal_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Train on a tenth of the profiles, store the model, score every share of the rows offered, evaluate each."""
    rows, path = profiles(spark, folder), new_path(spark, "model")
    train = split(rows, PROFILE_KEYS, 10).filter(F.col("part") == "train")
    save_model(fit_classifier(train, forest(), FOREST_INPUTS), path)
    model, result = load_model(path), None
    for pct, sample in exact_samples(rows, PROFILE_KEYS, (100, 80, 60, 40, 20)).items():
        part = binary_metrics(score(model, sample), "actual", "predicted")
        part = part.withColumn("pct", F.lit(pct))
        result = part if result is None else result.unionByName(part)
    return result


@query("q3d_rows", "SELECT pct, (count(*) * pct) // 100 AS n FROM hashed, (SELECT unnest([100, 80, 60, 40, 20]) AS pct) GROUP BY pct", *PROFILE_SQL)
def medal_classifier_rows(spark: SparkSession, folder: str) -> DataFrame:
    return medal_classifier(spark, folder).select("pct", "n")


def cohort_years(spark: SparkSession, folder: str) -> DataFrame:
    series = achievement_series(cohort(participation(spark, folder), "EUROPE", sport="city"))
    return stored(series.withColumn("cohort", F.lit("EUROPE")), "series")


@query("q4f_achievement_forecast")
def achievement_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Actual, fitted and forecast achievements of the cohort on the time axis, with the mean error of each model.

    Fitted values overlap the actuals; an autoregression has none for its first rows.
    """
    series = cohort_years(spark, folder)
    rows = history_with_future(series, horizon(series, "year", 10, 2, ["cohort"]))
    result = None
    for name, model in (("autoregression", Autoregression()), ("trend", TrendAndSeason())):
        values = model.forecast(rows, ["cohort"], "year", "y", fitted=True)
        joined = series.join(values, ["cohort", "year"], "full_outer")
        error = model.validate(series, ["cohort"], "year", "y").groupBy("cohort").agg(F.avg("mae").alias("mae"))
        part = joined.join(error, "cohort", "left").withColumn("model", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result.select("model", F.make_date(F.col("year"), F.lit(1), F.lit(1)).alias("ds"), "y", "yhat", "mae", "status")


@query("q4f_actuals_and_horizon", """
SELECT model, make_date(year, 1, 1) AS ds, y, forecast FROM (
  SELECT CAST(year AS BIGINT) AS year, y, false AS forecast FROM actuals
  UNION ALL SELECT top + 2 * i, NULL, true FROM (SELECT max(year) AS top FROM actuals), range(1, 11) AS r(i)),
  (SELECT unnest(['autoregression', 'trend']) AS model)""",
       "golds AS (SELECT * FROM rv WHERE medal = 'Gold' AND age < 26 AND continent = 'EUROPE')",
       """winners AS (SELECT name, count(*) AS gold_count FROM golds GROUP BY name HAVING count(*) >= 2 AND count(DISTINCT city) = 1)""",
       "others AS (SELECT name, count(*) AS other_count FROM rv WHERE medal <> 'Gold' GROUP BY name)",
       """actuals AS (SELECT year, CAST(sum(gold_count + coalesce(other_count, 0)) AS BIGINT) AS y FROM golds JOIN winners USING (name)
  LEFT JOIN others USING (name) GROUP BY year)""")
def achievement_horizon(spark: SparkSession, folder: str) -> DataFrame:
    """The time axis with the actuals; a year without an actual must have a forecast."""
    rows = achievement_forecast(spark, folder).filter(F.col("y").isNotNull() | F.col("yhat").isNotNull())
    return rows.select("model", "ds", "y", F.col("y").isNull().alias("forecast"))
