"""Evaluation of forecasts and classifications as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def mean_absolute_error(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), target: str = "mae") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias(target))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, actual: str, predicted: str, positive: int = 1) -> DataFrame:
    """One row: rows, accuracy, precision and recall of the positive class; an empty ratio is 0."""
    hit, guess, truth = F.col(actual) == F.col(predicted), F.col(predicted) == positive, F.col(actual) == positive
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("_hit"),
        F.count_if(guess & truth).alias("_tp"),
        F.count_if(guess).alias("_guess"),
        F.count_if(truth).alias("_truth"),
    )

    def ratio(part: str, whole: str):
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))

    return counts.select(
        "n",
        ratio("_hit", "n").alias("accuracy"),
        ratio("_tp", "_guess").alias("precision"),
        ratio("_tp", "_truth").alias("recall"),
    )


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with ``macro avg`` and ``weighted avg`` rows.

    Works on the confusion counts, which have one row per pair of classes.
    """
    cells = confusion(df, actual, predicted)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col(actual).cast("string").alias("class"), F.col("n").alias("truth"), F.lit(0).cast("bigint").alias("guess"),
                 F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(F.lit(0)).alias("hit")),
        F.struct(F.col(predicted).cast("string").alias("class"), F.lit(0).cast("bigint").alias("truth"), F.col("n").alias("guess"),
                 F.lit(0).cast("bigint").alias("hit")),
    )))
    zero = F.lit(0.0)
    per_class = (
        sides.groupBy("class").agg(F.sum("truth").alias("support"), F.sum("guess").alias("guess"), F.sum("hit").alias("hit"))
        .withColumn("precision", F.coalesce(F.try_divide("hit", "guess"), zero))
        .withColumn("recall", F.coalesce(F.try_divide("hit", "support"), zero))
        .withColumn("f1", F.coalesce(
            F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
        .select("class", "precision", "recall", "f1", "support")
    )
    names = ["precision", "recall", "f1"]
    macro = per_class.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = per_class.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")
    )
    return (
        per_class.unionByName(macro.withColumn("class", F.lit("macro avg")))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")))
    )
