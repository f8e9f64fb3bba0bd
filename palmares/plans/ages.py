"""Scenario 2: age patterns in the sports with most medals of a season."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from palmares.functions.scalar import decorated
from palmares.operators.aggregates import category_pivot, count_by, hierarchy, share, sum_by, typical_category, with_root_share, won
from palmares.operators.filters import apply_filters
from palmares.operators.joins import keep_listed
from palmares.operators.ranges import range_label
from palmares.operators.ranking import top_k_per_group
from palmares.plans.defaults import AGE_FILTERS, AGE_PATH
from palmares.store import stored


def season_top_sports(df: DataFrame, k: int = 3, century: int = 21) -> DataFrame:
    """The k sports with most medals of each season; equal counts rank by name."""
    counts = count_by(df.filter(won() & (F.col("century") == century)), ["season", "sport"])
    return top_k_per_group(counts, ["season"], k, ties=["sport"])


def in_top_sports(df: DataFrame, k: int = 3, century: int = 21) -> DataFrame:
    """Medal rows of all years in a sport that leads either season in the century.

    The list is stored: the counts behind it run once, and the planner sees that it is small.
    """
    listed = stored(season_top_sports(df, k, century).select("sport").distinct(), "top")
    return keep_listed(df.filter(won()), listed, "sport")


def medals_of_top_sports(df: DataFrame, k: int = 3, century: int = 21) -> DataFrame:
    rows = in_top_sports(df, k, century).filter(F.col("century") == century)
    return count_by(rows, ["year", "season", "sport", "medal", "sex", "age_bin"], "medal", "medals")


def medal_pivot_by_age(df: DataFrame, k: int = 3, century: int = 21) -> DataFrame:
    groups = medals_of_top_sports(df, k, century)
    return category_pivot(groups, ["sport", "season", "age_bin"], measure="medals", total="medals")


def mean_ages(df: DataFrame, k: int = 3, century: int = 21, all_years: bool = False) -> DataFrame:
    """Mean age of medallists per year, season, sport and sex, rounded to two places."""
    rows = in_top_sports(df, k, century)
    rows = rows if all_years else rows.filter(F.col("century") == century)
    return rows.groupBy("year", "season", "sport", "sex").agg(F.round(F.avg("age"), 2).alias("mean_age"))


def ages_with_typical_medal(df: DataFrame, k: int = 3, century: int = 21, all_years: bool = False) -> DataFrame:
    """Mean age with its age group and the medal won most often by that sport, sex and age group.

    The age group of a mean is the first label whose range holds it; the typical medal counts all years.
    """
    labelled = range_label(
        mean_ages(df, k, century, all_years), "mean_age", df.select("age_bin").distinct(), "age_bin", "age_bin"
    )
    typical = typical_category(in_top_sports(df, k, century), ["sport", "sex", "age_bin"])
    return labelled.join(typical, ["sport", "sex", "age_bin"], "left")


def age_share(
    groups: DataFrame,
    chosen: Mapping[str, Sequence[str]] | None = None,
    defaults: Mapping[str, Sequence[str]] | None = None,
    by_sex: bool = False,
) -> DataFrame:
    """Share of every age group, or of every age group and sex, in the medals of the chosen rows."""
    rows = apply_filters(groups, chosen or {}, defaults)
    label = decorated(F.col("age_bin"), F.col("sex")) if by_sex else F.col("age_bin")
    return share(rows.withColumn("label", label), "label", "medals", "medals")


def age_hierarchy(groups: DataFrame, path: Sequence[str] = ()) -> DataFrame:
    """Medals and branch share at every level of a chosen path; an empty choice stands for ``AGE_PATH``."""
    levels = list(path) or AGE_PATH
    return with_root_share(hierarchy(groups, levels, "medals", "medals"), levels, "medals")


def season_series(
    groups: DataFrame, season: str, chosen: Mapping[str, Sequence[str]] | None = None, defaults: Mapping[str, Sequence[str]] = AGE_FILTERS,
) -> DataFrame:
    """Medals of one season by age group, medal and sport, for the chosen sports and sexes."""
    rows = apply_filters(groups.filter(F.col("season") == season), chosen or {}, defaults)
    return sum_by(rows, ["age_bin", "medal", "sport"], "medals", "medals")


def stacked_series(
    groups: DataFrame, chosen: Mapping[str, Sequence[str]] | None = None, defaults: Mapping[str, Sequence[str]] = AGE_FILTERS,
) -> DataFrame:
    """Medals by age group and medal, one series an age group, for the chosen sports and sexes of both seasons."""
    return sum_by(apply_filters(groups, chosen or {}, defaults), ["age_bin", "medal"], "medals", "medals")
