"""Scenario 3: body measures of one country's medallists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from palmares.functions.bins import equal_width_bins
from palmares.functions.recode import recode
from palmares.functions.scalar import body_mass_index
from palmares.operators.aggregates import count_by, hierarchy, with_root_share, won
from palmares.operators.encode import first_seen_index
from palmares.operators.impute import fill_body_measures
from palmares.operators.joins import keep_listed
from palmares.operators.filters import apply_filters
from palmares.operators.ranking import top_k
from palmares.plans.defaults import BODY_FILTERS
from palmares.store import stored

GROUPS = ("team", "sport", "sex", "height", "weight", "age", "age_bin", "bmi", "bmi_bin", "medal")


def country_bodies(df: DataFrame, noc: str, k: int = 5, low: float = 18.5, high: float = 35.0) -> DataFrame:
    """Rows of one country in its k largest sports with body mass index and its equal-width group.

    Missing measures are filled from the means of all countries before the country is chosen. The rows of the
    country are stored, because the extremes of the index and the rows themselves are both read from them.
    """
    country = stored(fill_body_measures(df).filter(F.col("noc") == noc), "country")
    top = top_k(count_by(country, ["sport"]), k, ties=["sport"]).select("sport")
    rows = keep_listed(country, F.broadcast(top), "sport").withColumn(
        "bmi", F.round(body_mass_index("weight", "height"), 2)
    )
    return equal_width_bins(rows.filter(F.col("bmi").between(low, high)), "bmi", "bmi_bin")


def body_groups(
    bodies: DataFrame,
    since: int = 1945,
    medals_only: bool = True,
    keys: Sequence[str] = GROUPS,
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows per profile since a year; ``rename`` unites team names after the count, so profiles can repeat.

    The profiles are stored, since every view of the scenario reads them more than once.
    """
    rows = bodies.filter(F.col("year") >= since)
    groups = stored(count_by(rows.filter(won()) if medals_only else rows, keys, "medal", "medals"), "profiles")
    return groups.withColumn("team", recode("team", rename)) if rename else groups


def body_points(
    groups: DataFrame, chosen: Mapping[str, Sequence[str]] | None = None, defaults: Mapping[str, Sequence[str]] = BODY_FILTERS,
) -> DataFrame:
    """The profiles of the chosen sports, age groups and index groups as points: age, index, weight, sex and medal."""
    return apply_filters(groups, chosen or {}, defaults).select("age", "bmi", "weight", "sex", "sport", "medal")


def body_hierarchy(groups: DataFrame, path: Sequence[str]) -> DataFrame:
    """Medals and branch share at every level of a path over distinct profiles."""
    return with_root_share(hierarchy(groups.dropDuplicates(), path, "medals", "medals"), path, "medals")


def parallel_axes(groups: DataFrame, categories: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Profiles with one integer column ``<category>_at`` per category, numbered by first appearance."""
    return first_seen_index(groups, {c: f"{c}_at" for c in categories}, order)


def axis_ranges(groups: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value of every axis, one row per axis."""
    ends = groups.agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))])
    return ends.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("axis"), F.col(f"lo_{c}").cast("double").alias("lo"),
                 F.col(f"hi_{c}").cast("double").alias("hi"))
        for c in columns
    ])))
