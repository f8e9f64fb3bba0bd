"""Preparation: raw participation rows to the prepared table that every scenario reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from palmares.functions.bins import age_bin, decade_bin
from palmares.functions.recode import recode
from palmares.functions.scalar import century, word
from palmares.operators.aggregates import count_by
from palmares.operators.impute import fill_body_measures, with_group_mean
from palmares.operators.joins import attach, lookup
from palmares.schemas import CONTINENT_NAMES, DEFAULT_CONTINENT, MEDAL_NAMES, NO_MEDAL, SEX_NAMES
from palmares.store import stored


def split_games(df: DataFrame, games: str = "games") -> DataFrame:
    """Year, season and century out of a text such as ``1992 Summer``; null where a part is missing."""
    year = word(games, 0).try_cast("int")
    return df.withColumns({"year": year, "season": word(games, 1), "century": century(year)})


def with_continent(
    df: DataFrame,
    codes: DataFrame,
    names: Mapping[str, str] = CONTINENT_NAMES,
    default: str = DEFAULT_CONTINENT,
    key: str = "noc",
) -> DataFrame:
    """Continent name of the country code; a code the lookup lacks takes the ``default`` continent."""
    coded = lookup(df, key, codes, "ioc", "continent", "continent", default)
    return coded.withColumn("continent", recode("continent", names, default=None))


def prepare(
    raw: DataFrame,
    codes: DataFrame,
    names: Mapping[str, str] = CONTINENT_NAMES,
    default: str = DEFAULT_CONTINENT,
) -> DataFrame:
    """The five preparation steps. Filters come first, so that they reach the scan below the lookup join."""
    known = raw.filter(F.col("sex").isNotNull() & (F.col("age") >= 0)).withColumn("age_bin", age_bin("age"))
    known = split_games(known.filter(F.col("age_bin").isNotNull()))
    recoded = known.withColumns({
        "sex": recode("sex", SEX_NAMES),
        "medal": recode("medal", MEDAL_NAMES, null_as=NO_MEDAL),
    })
    return with_continent(recoded, codes, names, default)


def prepare_early(
    raw: DataFrame,
    codes: DataFrame,
    names: Mapping[str, str] = CONTINENT_NAMES,
    default: str = DEFAULT_CONTINENT,
) -> DataFrame:
    """The earlier preparation: imputed body measures, age groups of ten years, medals per country and mean age.

    ``medal`` keeps its nulls here. Country and sport-year values are means and counts over the kept rows, which
    are stored between the two steps.
    """
    filled = fill_body_measures(raw.na.drop(subset=["age"]))
    filled = stored(split_games(filled).withColumn("age_group", decade_bin("age")), "filled")
    medals = count_by(filled.filter(F.col("medal").isNotNull()), ["noc"], target="medal_count")
    counted = attach(filled, medals, "noc")
    aged = with_group_mean(counted, "age", ["year", "sport"], "average_age", digits=2)
    coded = lookup(aged, "noc", codes, "ioc", "continent", "cc", default)
    return coded.withColumn("continent", recode("cc", names, default=None))
