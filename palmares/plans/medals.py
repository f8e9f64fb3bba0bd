"""Scenario 1: medals won by continents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from palmares.functions.recode import override
from palmares.operators.aggregates import category_pivot, count_by, hierarchy, won, yearly_profile
from palmares.operators.filters import apply_filters
from palmares.operators.series import with_cyclic_year
from palmares.schemas import MEDALS, NO_MEDAL


def relocated(df: DataFrame, moved: tuple[str, str] | None) -> DataFrame:
    """``df`` with one country placed on another continent; ``moved`` = (country code, continent), none by default."""
    return df.withColumn("continent", override("continent", "noc", *moved)) if moved else df


def medal_groups(df: DataFrame, moved: tuple[str, str] | None = None) -> DataFrame:
    """Medals by continent, season, medal, sex and age group."""
    return count_by(relocated(df, moved).filter(won()), ["continent", "season", "medal", "sex", "age_bin"], "medal", "medals")


def medal_table(df: DataFrame, moved: tuple[str, str] | None = None) -> DataFrame:
    """Gold, silver, bronze and total per continent and season."""
    return category_pivot(relocated(df, moved).filter(F.col("medal").isin(MEDALS)), ["continent", "season"], total="medals")


def medals_by_age(df: DataFrame, season: str | None = None, moved: tuple[str, str] | None = None) -> DataFrame:
    """Medals by continent, season and age group, optionally of one season."""
    rows = relocated(df, moved).filter(won())
    rows = rows.filter(F.col("season") == season) if season else rows
    return count_by(rows, ["continent", "season", "age_bin"], "medal", "medals")


def medal_hierarchy(df: DataFrame, path: Sequence[str] = ("continent", "season", "medal")) -> DataFrame:
    """Medals at every level of a path over the group columns."""
    return hierarchy(df.filter(won()), path, target="medals")


def medal_map(
    df: DataFrame,
    regions: DataFrame,
    region_key: str,
    fact_key: str = "noc",
    continents: Sequence[str] = (),
    moved: tuple[str, str] | None = None,
) -> DataFrame:
    """Medal count on every region of the dimension, null where the key has none.

    ``continents`` are chosen by the continents of the table, before ``moved`` places a country on another one.
    """
    rows = relocated(apply_filters(df.filter(won()), {"continent": continents}), moved)
    counts = count_by(rows, [fact_key], "medal", "medals").withColumnRenamed(fact_key, "_key")
    return regions.join(counts, F.col(region_key) == F.col("_key"), "left").drop("_key")


def yearly_features(df: DataFrame, moved: tuple[str, str] | None = None) -> DataFrame:
    """Profile per year, season and continent with the cyclic encoding on the last year of the whole table."""
    return with_cyclic_year(yearly_profile(relocated(df, moved).fillna(NO_MEDAL, ["medal"])))
