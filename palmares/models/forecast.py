"""Forecasts of yearly series.

Input rows carry ``kind``: ``history`` rows have the value, ``forecast`` rows are to be predicted. Autoregressions and trends
are least squares over all series at once (``palmares.models.sums``): features, sums and the way ahead are Spark expressions.
Trees are one pooled Spark ML fit over all series, with the series as one-hot features.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from math import pi

from pyspark import cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from palmares.models import sums
from palmares.operators.encode import label_index
from palmares.operators.metrics import mean_absolute_error
from palmares.store import stored

# The functions of these modules travel with the job, so the package need not be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sums)

SERIES = "_series"


class Linear:
    """A least-squares model of many series; ``folds`` counts in all its frames, fold ``folds + 1`` trains on all rows."""

    def forecast(self, rows: DataFrame, by: Sequence[str], time: str, value: str, target: str = "yhat", fitted: bool = False) -> DataFrame:
        """(by, time, target, status) of the ``forecast`` rows of every series, and with ``fitted`` of its ``history`` rows.

        A fitted value is the model's for a row that it has seen; it is null where the model has no inputs yet. A series
        without history has null predictions and the status ``no history``.
        """
        packed = rows.select(F.struct(*by).alias(SERIES), time, "kind", F.col(value).cast("double").alias("value"))
        history = packed.filter(F.col("kind") == "history").drop("kind")
        future = packed.filter(F.col("kind") == "forecast").select(SERIES, time)
        seen = stored(sums.in_stretches(history, SERIES, time, 0), "series")
        out = self._forecast(seen, future, time, target, fitted)
        status = F.coalesce("status", F.lit("no history"))
        return out.select(*[F.col(f"{SERIES}.{c}").alias(c) for c in by], time, target, status.alias("status"))

    def validate(self, series: DataFrame, by: Sequence[str], time: str, value: str, folds: int = 5) -> DataFrame:
        """(by, fold, status, mae): the mean absolute error in each expanding-window fold of every series.

        A series too short for the folds has one row without fold and error and the status ``too_short``.
        """
        packed = series.select(F.struct(*by).alias(SERIES), time, F.col(value).cast("double").alias("value"))
        seen = stored(sums.in_stretches(packed, SERIES, time, folds), "series")
        tested = self._tested(seen, time, folds)
        errors = mean_absolute_error(tested, "value", "yhat", [SERIES, "fold", "status"])
        short = seen.filter(F.col("size") == 0).select(SERIES, F.lit(None).cast("int").alias("fold"), F.lit("too_short").alias("status")).distinct()
        out = errors.unionByName(short.withColumn("mae", F.lit(None).cast("double")))
        return out.select(*[F.col(f"{SERIES}.{c}").alias(c) for c in by], "fold", "status", "mae")


class Autoregression(Linear):
    """Autoregression without constant on the series or on its first differences.

    A series of n values uses at most (n - differences - 1) // 2 lags. The status is ``ok`` with all lags, ``lags=p`` with fewer,
    ``repeats last value`` with none.
    """

    def __init__(self, lags: int = 5, differences: int = 1):
        if lags < 1 or differences not in (0, 1):
            raise ValueError("at least one lag, and no or one difference")
        self.lags, self.differences = lags, differences

    def order(self, n: Column) -> Column:
        return F.greatest(F.least(F.floor((n - self.differences - 1) / 2), F.lit(self.lags)), F.lit(0)).cast("int")

    def _status(self, order: str) -> Column:
        short = F.when(F.col(order) > 0, F.concat(F.lit("lags="), F.col(order).cast("string"))).otherwise("repeats last value")
        return F.when(F.col(order) == self.lags, F.lit("ok")).otherwise(short)

    def lagged(self, rows: DataFrame, time: str) -> DataFrame:
        """``rows`` with the step ``x`` and its former values ``past``, the latest first."""
        w = Window.partitionBy(SERIES).orderBy(time)
        step = F.col("value") - F.lag("value").over(w) if self.differences else F.col("value")
        steps = rows.withColumn("x", step)
        return steps.withColumn("past", F.array(*[F.lag("x", i).over(w) for i in range(1, self.lags + 1)]))

    def fits(self, lagged: DataFrame, folds: int) -> DataFrame:
        """(series, fold, n_train, size, order, status, weights, value, recent): the fit of each fold and where it stands."""
        fold = sums.fold_rows(lagged, SERIES, folds).withColumn("order", self.order(F.col("n_train")))
        # The rows of a fit depend on its order, which grows with the fold: a row counts for every order that a fold has.
        orders = lambda n, size: F.array_distinct(F.transform(
            F.sequence(F.when(size > 0, F.lit(1)).otherwise(F.lit(folds + 1)), F.lit(folds + 1)), lambda k: self.order(n - (folds + 1 - k) * size)
        ))
        spread = lagged.withColumn("order", F.explode(orders(F.col("n"), F.col("size"))))
        spread = spread.filter((F.col("order") > 0) & (F.col("at") >= F.col("order") + self.differences))
        spread = spread.withColumn("inputs", F.transform("past", lambda x, i: F.when(i < F.col("order"), x).otherwise(0.0)))
        sides = sums.moments(spread.select(SERIES, "order", "stretch", "inputs", "x"), [SERIES, "order"], "inputs", "x", folds)
        joined = fold.join(sides, [SERIES, "fold", "order"], "left")
        # Folds without sums have an order of 0; their weights are not used.
        empty = F.array(*[F.lit(0.0)] * (self.lags + 1) ** 2)
        joined = joined.withColumn("sums", F.coalesce("sums", empty)).withColumn("weights", sums.weights_of("sums", [0.0] * self.lags)).drop("sums")
        ends = lagged.select(SERIES, (F.col("at") + 1).alias("n_train"), "value", F.slice(F.concat(F.array("x"), "past"), 1, self.lags).alias("recent"))
        ends = ends.withColumn("recent", F.transform("recent", lambda x: F.coalesce(x, F.lit(0.0))))
        return joined.join(ends, [SERIES, "n_train"]).withColumn("status", self._status("order"))

    def ahead(self, fits: DataFrame, steps: Column) -> DataFrame:
        """(series, fold, status, step, yhat): the steps after the training rows, each from the ones before it."""
        start = F.struct(F.col("value").alias("level"), F.col("recent").alias("recent"), F.array().cast("array<double>").alias("path"))

        def walk(state: Column, _: Column) -> Column:
            step = sums.dot(F.col("weights"), state["recent"])
            level = state["level"] + step if self.differences else step
            level = F.when(F.col("order") > 0, level).otherwise(state["level"])
            recent = F.slice(F.concat(F.array(step), state["recent"]), 1, self.lags)
            return F.struct(level.alias("level"), recent.alias("recent"), F.concat(state["path"], F.array(level)).alias("path"))

        some = fits.filter(steps > 0)
        path = F.aggregate(F.sequence(F.lit(1), steps.cast("int")), start, walk, lambda state: state["path"])
        return some.select(SERIES, "fold", "n_train", "status", F.posexplode(path).alias("step", "yhat"))

    def _forecast(self, seen: DataFrame, future: DataFrame, time: str, target: str, fitted: bool) -> DataFrame:
        lagged = stored(self.lagged(seen, time), "lagged")
        fits = stored(self.fits(lagged, 0), "fits")
        numbered = future.withColumn("step", F.row_number().over(Window.partitionBy(SERIES).orderBy(time)) - 1)
        wanted = numbered.groupBy(SERIES).agg(F.count(F.lit(1)).alias("steps"))
        ahead = self.ahead(fits.join(wanted, SERIES), F.col("steps")).select(SERIES, "step", "status", F.col("yhat").alias(target))
        out = numbered.join(ahead, [SERIES, "step"], "left").select(SERIES, time, target, "status")
        if not fitted:
            return out
        step = sums.dot(F.col("weights"), F.transform("past", lambda x: F.coalesce(x, F.lit(0.0))))
        level = F.col("value") - F.col("x") + step if self.differences else step
        known = (F.col("at") >= F.col("order") + self.differences) & (F.col("order") > 0)
        rows = lagged.join(fits.select(SERIES, "order", "weights", "status"), SERIES)
        return rows.select(SERIES, time, F.when(known, level).alias(target), "status").unionByName(out)

    def _tested(self, seen: DataFrame, time: str, folds: int) -> DataFrame:
        lagged = stored(self.lagged(seen, time), "lagged")
        ahead = self.ahead(self.fits(lagged, folds).filter(F.col("fold") <= folds), F.col("size"))
        tested = ahead.select(SERIES, "fold", "status", (F.col("n_train") + F.col("step")).alias("at"), "yhat")
        return lagged.select(SERIES, "at", "value").join(tested, [SERIES, "at"])


class TrendAndSeason(Linear):
    """Piecewise-linear trend plus yearly Fourier terms over times in years, by penalised least squares.

    Bends lie at quantiles of the first four fifths of the times; slope changes and waves are penalised, the line is not. The
    bends of all folds are those of the whole series; bends after the training rows get no weight. The status is ``ok`` with all
    bends, ``bends=k`` with fewer.
    """

    def __init__(self, bends: int = 25, waves: int = 10, ridge: float = 1.0):
        self.bends, self.waves, self.ridge = bends, waves, ridge
        self.penalty = [0.0, 0.0] + [ridge] * (bends + 2 * waves)

    def shapes(self, seen: DataFrame, time: str) -> DataFrame:
        """(series, low, span, knots, status) from the times of a series."""
        times = F.sort_array(F.collect_list(F.col(time).cast("double")))
        shape = seen.groupBy(SERIES).agg(times.alias("times"))
        n = F.size("times")
        used = F.least(F.lit(self.bends), n - 1)
        place = lambda j: (n - 1) * F.lit(0.8) * j / used

        def knot(j: Column) -> Column:
            low = F.floor(place(j)).cast("int")
            a, b = F.get("times", low), F.get("times", F.least(low + 1, n - 1))
            return a + (place(j) - low) * (b - a)

        knots = F.when(used > 0, F.transform(F.sequence(F.lit(1), used), knot)).otherwise(F.array().cast("array<double>"))
        status = F.when(n > self.bends, F.lit("ok")).otherwise(F.concat(F.lit("bends="), (n - 1).cast("string")))
        low, high = F.get("times", F.lit(0)), F.get("times", n - 1)
        return shape.select(SERIES, low.alias("low"), F.greatest(high - low, F.lit(1.0)).alias("span"), knots.alias("knots"), status.alias("status"))

    def design(self, time: str) -> Column:
        """The inputs at a time: one, the line, hinges (those a short series lacks are 0), sines and cosines."""
        t = F.col(time).cast("double")
        hinges = F.transform(F.sequence(F.lit(0), F.lit(self.bends - 1)), lambda i: F.coalesce(F.greatest(t - F.get("knots", i), F.lit(0.0)) / F.col("span"), F.lit(0.0)))
        season = [f(F.lit(2 * pi * n) * t) for n in range(1, self.waves + 1) for f in (F.sin, F.cos)]
        return F.concat(F.array(F.lit(1.0), (t - F.col("low")) / F.col("span")), hinges if self.bends else F.array().cast("array<double>"), F.array(*season).cast("array<double>"))

    def fits(self, shaped: DataFrame, folds: int) -> DataFrame:
        """(series, fold, weights) from rows with ``inputs`` and ``value``."""
        sides = sums.moments(shaped.select(SERIES, "stretch", "inputs", "value"), [SERIES], "inputs", "value", folds)
        return sides.select(SERIES, "fold", sums.weights_of("sums", self.penalty).alias("weights"))

    def _forecast(self, seen: DataFrame, future: DataFrame, time: str, target: str, fitted: bool) -> DataFrame:
        shapes = stored(self.shapes(seen, time), "shapes")
        fits = self.fits(seen.join(shapes, SERIES).withColumn("inputs", self.design(time)), 0).select(SERIES, "weights")
        fits = stored(shapes.join(fits, SERIES), "fits")
        rows = future.unionByName(seen.select(SERIES, time)) if fitted else future
        out = rows.join(fits, SERIES, "left").withColumn(target, sums.dot(F.col("weights"), self.design(time)))
        return out.select(SERIES, time, target, "status")

    def _tested(self, seen: DataFrame, time: str, folds: int) -> DataFrame:
        shaped = stored(seen.join(self.shapes(seen, time), SERIES).withColumn("inputs", self.design(time)), "design")
        fits = self.fits(shaped, folds)
        tested = shaped.filter(F.col("stretch") > 0).withColumn("fold", F.col("stretch"))
        return tested.join(fits, [SERIES, "fold"]).select(SERIES, "fold", "status", "value", sums.dot(F.col("weights"), F.col("inputs")).alias("yhat"))


def random_forest(trees: int = 500, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, maxDepth=10, seed=seed, featuresCol="features")


def boosted_trees(trees: int = 500, depth: int = 3, rate: float = 0.1, seed: int = 42) -> GBTRegressor:
    """Boosting is sequential: every tree is a few Spark jobs, whatever the size of the data."""
    return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, featuresCol="features")


def pooled_forecast(
    history: DataFrame, future: DataFrame, by: Sequence[str], inputs: Sequence[str], value: str, regressor,
    target: str = "yhat",
) -> DataFrame:
    """Fit one model over the history of all series and predict the future rows.

    Series are coded by position among the sorted names, which a join brings to the rows; a name that the history lacks, and
    a missing one, have no code and share a feature of their own.
    """
    names = [f"_{c}_at" for c in by]
    rows = history.select(*by, *inputs, F.col(value).cast("double").alias("_label"), F.lit(True).alias("_known"))
    rows = rows.unionByName(future.select(F.struct(*future.columns).alias("_row"), *by, *inputs, F.lit(False).alias("_known")), allowMissingColumns=True)
    coded = label_index(rows, dict(zip(by, names))).withColumns({c: F.coalesce(F.col(c) + 1, F.lit(0)).cast("double") for c in names})
    coded = stored(coded, "coded")
    train = coded.filter(F.col("_known")).na.drop(subset=[*inputs, "_label"])
    hot = [f"_{c}_hot" for c in by]
    stages = [
        OneHotEncoder(inputCols=names, outputCols=hot, dropLast=False, handleInvalid="keep"),
        VectorAssembler(inputCols=[*inputs, *hot], outputCol="features"),
        regressor.copy().setLabelCol("_label").setPredictionCol(target),
    ]
    predicted = Pipeline(stages=stages).fit(train).transform(coded.filter(~F.col("_known")))
    return predicted.select("_row.*", target)
