"""Explicit schemas and the fixed values of the participation model."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels, edges and code names that results must carry.
FEMALE, MALE = "Female", "Male"
SEX_NAMES = {"F": FEMALE, "M": MALE}
GOLD, SILVER, BRONZE, NO_MEDAL = "Gold", "Silver", "Bronze", "No medal"
MEDAL_NAMES = {"G": GOLD, "S": SILVER, "B": BRONZE}
MEDALS = [GOLD, SILVER, BRONZE]
SUMMER, WINTER = "Summer", "Winter"
AGE_EDGES = [0, 20, 25, 30, 40, 60, 100]
DECADE_EDGES = [0, 20, 30, 40, 50, 60, 70, 80, 90, 100]
SAME_YEAR = "S.Y."
CONTINENT_NAMES = {
    "AS": "Asia",
    "EU": "Europe",
    "AF": "Africa",
    "OC": "Oceania",
    "NA": "North America",
    "SA": "South America",
    "AN": "Antarctica",
    "UT": "Unified Team",
}
DEFAULT_CONTINENT = "NA"
PREDECESSORS = {"GER": ["FRG", "GDR"]}
FORECAST_YEARS = [2020, 2024, 2028, 2032, 2036]

RAW = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("sex", T.StringType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("height", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("team", T.StringType()),
    T.StructField("noc", T.StringType()),
    T.StructField("games", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("season", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("sport", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("medal", T.StringType()),
])

PREPARED = T.StructType(RAW.fields + [
    T.StructField("century", T.IntegerType()),
    T.StructField("age_bin", T.StringType()),
    T.StructField("continent", T.StringType()),
])

LOOKUP = T.StructType([
    T.StructField("ioc", T.StringType()),
    T.StructField("continent", T.StringType()),
])
