"""Yearly series: horizons, cyclic encodings, lags, history with future rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from palmares.functions.scalar import cyclic
from palmares.schemas import FORECAST_YEARS


def with_cyclic_year(df: DataFrame, year: str = "year", top: Column | None = None) -> DataFrame:
    """``year_sin`` and ``year_cos``; a full turn is the latest year of the whole frame unless ``top`` is given."""
    sine, cosine = cyclic(year, df.agg(F.max(year)).scalar() if top is None else top)
    return df.withColumns({"year_sin": sine, "year_cos": cosine})


def lag_features(series: DataFrame, order: str, value: str, lags: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """First difference ``d1`` and its ``lag1`` to ``lagN`` in a series with one row per period."""
    w = Window.partitionBy(*by).orderBy(order)
    out = series.withColumn("d1", F.col(value) - F.lag(value, 1).over(w))
    return out.withColumns({f"lag{i}": F.lag("d1", i).over(w) for i in range(1, lags + 1)})


def horizon(series: DataFrame, time: str, steps: int, step: int, by: Sequence[str] = ()) -> DataFrame:
    """``steps`` future periods after the last one of every series, ``step`` apart."""
    last = series.groupBy(*by).agg(F.max(time).alias("_last"))
    ahead = F.sequence(F.col("_last") + step, F.col("_last") + step * steps, F.lit(step))
    return last.select(*by, F.explode(ahead).alias(time))


def fixed_horizon(series: DataFrame, time: str, years: Sequence[int], by: Sequence[str]) -> DataFrame:
    """The same list of future periods for every series."""
    return series.select(*by).distinct().withColumn(time, F.explode(F.array(*[F.lit(y) for y in years])))


def history_with_future(history: DataFrame, future: DataFrame) -> DataFrame:
    """Both parts in one frame, told apart by ``kind``; a column of one part only is null in the other."""
    return history.withColumn("kind", F.lit("history")).unionByName(
        future.withColumn("kind", F.lit("forecast")), allowMissingColumns=True
    )


def future_rows(
    profile: DataFrame,
    by: Sequence[str] = ("season", "continent"),
    covariates: Sequence[str] = ("athletes", "mean_age"),
    year: str = "year",
    years: Sequence[int] = FORECAST_YEARS,
) -> DataFrame:
    """Future years per series with the mean covariates of its history and the year encoded on its last year."""
    means = profile.groupBy(*by).agg(F.max(year).alias("_top"), *[F.avg(c).alias(c) for c in covariates])
    rows = means.withColumn(year, F.explode(F.array(*[F.lit(y) for y in years])))
    return with_cyclic_year(rows, year, F.col("_top")).drop("_top")
