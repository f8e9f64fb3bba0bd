"""Scenario 4: young athletes of one continent with two or more gold medals in one single sport."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from palmares.functions.scalar import decorated
from palmares.operators.aggregates import count_by, hierarchy, share
from palmares.operators.filters import apply_filters, expand_values
from palmares.operators.gaps import gap_label, second_success
from palmares.operators.impute import fill_with_group_mean
from palmares.operators.joins import attach, keep_listed
from palmares.operators.ranking import one_per_key
from palmares.plans.medals import relocated
from palmares.schemas import GOLD
from palmares.store import stored


def young_golds(df: DataFrame, continent: str = "Europe", under: float = 26, moved: tuple[str, str] | None = None) -> DataFrame:
    return relocated(df, moved).filter((F.col("medal") == GOLD) & (F.col("age") < under) & (F.col("continent") == continent))


def single_sport_winners(golds: DataFrame, athlete: str = "name", sport: str = "sport", at_least: int = 2) -> DataFrame:
    """Athletes with enough golds, all in one sport: gold count and number of sports per athlete.

    Golds are summed per athlete and sport first, so an athlete with very many rows is combined on the map side.
    """
    per_sport = golds.groupBy(athlete, sport).agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_sport.groupBy(athlete)
        .agg(F.sum("_n").alias("gold_count"), F.count(sport).alias("unique_sports"))
        .filter((F.col("gold_count") >= at_least) & (F.col("unique_sports") == 1))
    )


def double_winners(
    df: DataFrame,
    continent: str = "Europe",
    under: float = 26,
    at_least: int = 2,
    athlete: str = "name",
    sport: str = "sport",
    moved: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per gold of the chosen athletes with gold count, number of sports and time to the second gold.

    ``moved`` = (country code, continent) places one country on another continent first.
    """
    golds = young_golds(df, continent, under, moved)
    winners = single_sport_winners(golds, athlete, sport, at_least)
    waits = second_success(golds, athlete).select(athlete, gap_label().alias("years_to_two"))
    return attach(golds, winners.join(waits, athlete), athlete, "inner")


def chosen_winners(winners: DataFrame, chosen: Mapping[str, Sequence[str]] | None, defaults: Mapping[str, Sequence[str]] | None) -> DataFrame:
    """Rows of the chosen values; a chosen country stands for its predecessors too."""
    lists = dict(chosen or {})
    if lists.get("noc"):
        lists["noc"] = expand_values(lists["noc"])
    return apply_filters(winners, lists, defaults)


def golds_by_age(
    winners: DataFrame, chosen: Mapping[str, Sequence[str]] | None = None,
    defaults: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    rows = chosen_winners(winners, chosen, defaults)
    return count_by(rows.filter(F.col("medal") == GOLD), ["year", "age", "sex"])


def age_at_first_gold(
    winners: DataFrame, chosen: Mapping[str, Sequence[str]] | None = None,
    defaults: Mapping[str, Sequence[str]] | None = None, athlete: str = "name", sport: str = "sport",
) -> DataFrame:
    """Athletes by age, sex and sport of their first gold among the chosen rows."""
    rows = chosen_winners(winners, chosen, defaults).select(athlete, "year", "age", sport, "event", "sex")
    first = one_per_key(rows, [athlete], ["year", "age", sport, "event"])
    return count_by(first, ["age", "sex", sport])


def wait_share(
    winners: DataFrame, chosen: Mapping[str, Sequence[str]] | None = None,
    defaults: Mapping[str, Sequence[str]] | None = None, by_sex: bool = False,
) -> DataFrame:
    """Share of every time to the second gold, optionally with the sex, in the rows of the chosen countries."""
    rows = chosen_winners(winners, chosen, defaults)
    label = decorated(F.col("years_to_two"), F.col("sex")) if by_sex else F.col("years_to_two")
    return share(rows.withColumn("label", label), "label", amount="n")


def winner_hierarchy(
    winners: DataFrame, path: Sequence[str] = ("continent", "season", "sport", "sex", "years_to_two")
) -> DataFrame:
    return hierarchy(winners, path, target="n")


def flows(
    winners: DataFrame,
    dims: Sequence[str] = ("continent", "sex", "age", "years_to_two", "season", "gold_count", "medal"),
) -> DataFrame:
    """Rows per combination of categories."""
    return count_by(winners, dims)


def cohort(
    df: DataFrame, continent: str = "Europe", under: float = 26, athlete: str = "name", sport: str = "sport",
    moved: tuple[str, str] | None = None,
) -> DataFrame:
    """Golds of the cohort with the number of the athlete's other rows and filled body measures.

    Every row that is not a gold counts as another achievement, also one without a medal.
    """
    golds = young_golds(df, continent, under, moved)
    winners = stored(single_sport_winners(golds, athlete, sport), "winners")
    rows = golds.join(winners, athlete)
    others = keep_listed(df.filter(F.col("medal") != GOLD), winners.select(athlete), athlete)
    rows = attach(rows, count_by(others, [athlete], "medal", "other_count"), athlete).fillna(0, ["other_count"])
    return fill_with_group_mean(rows, ["height", "weight"], sport)


def achievement_series(rows: DataFrame) -> DataFrame:
    """Achievements per year: golds and other rows of the athlete, summed over the gold rows of the year.

    The totals of an athlete enter once per gold row. Rows without body measures are left out.
    """
    amount = (F.col("gold_count") + F.col("other_count")).alias("amount")
    complete = rows.na.drop(subset=["height", "weight"]).select("year", amount)
    return complete.groupBy("year").agg(F.sum("amount").alias("y"))
