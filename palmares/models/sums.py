"""Linear least squares from grouped sums.

A model with m inputs needs of its rows only the sums of products of inputs and target, (m + 1) squared numbers. Sums add up:
rows are summed by series and by stretch of time between the folds, and the fold that trains on the first stretches adds
their sums. So all folds of all series, and the fit to all rows, come from one pass over the rows. Only the small systems
are solved in Python, many to a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

#: Directions in which the rows hardly differ (relative to the largest sum of squares) get no weight.
RANK = 1e-12


def in_stretches(series: DataFrame, key: str, time: str, folds: int) -> DataFrame:
    """Rows with ``at`` (from 0) and ``n`` of their series, the ``size`` of a fold, and their ``stretch``.

    Fold k tests stretch k, of ``n // (folds + 1)`` rows, and trains on all stretches before it. In a series with too few rows
    for the folds all rows are in stretch 0 and ``size`` is 0. One row per period is expected.
    """
    rows = series.withColumns({
        "at": F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1,
        "n": F.count(F.lit(1)).over(Window.partitionBy(key)).cast("int"),
    })
    rows = rows.withColumn("size", F.floor(F.col("n") / (folds + 1)).cast("int"))
    first = F.col("n") - folds * F.col("size")
    stretch = F.when((F.col("size") > 0) & (F.col("at") >= first), F.floor((F.col("at") - first) / F.col("size")) + 1).otherwise(0)
    return rows.withColumn("stretch", stretch.cast("int"))


def fold_rows(rows: DataFrame, key: str, folds: int) -> DataFrame:
    """(key, fold, n_train, size) of every fold of every series, and of the fit to all rows as fold ``folds + 1``."""
    series = rows.groupBy(key).agg(F.first("n").alias("n"), F.first("size").alias("size"))
    every = F.when(F.col("size") > 0, F.sequence(F.lit(1), F.lit(folds + 1))).otherwise(F.array(F.lit(folds + 1)))
    spread = series.select(key, "n", "size", F.explode(every).alias("fold"))
    return spread.select(key, "fold", (F.col("n") - (folds + 1 - F.col("fold")) * F.col("size")).alias("n_train"), "size")


def moments(rows: DataFrame, by: Sequence[str], inputs: str, target: str, folds: int) -> DataFrame:
    """(by, fold, sums): of each group and fold the sums of products of ``inputs`` and ``target``, row after row of the matrix."""
    z = F.concat(inputs, F.array(F.col(target).cast("double")))
    products = F.flatten(F.transform(z, lambda a: F.transform(z, lambda b: a * b)))
    cells = rows.select(*by, "stretch", F.posexplode(products).alias("cell", "product"))
    sums = cells.groupBy(*by, "stretch", "cell").agg(F.sum("product").alias("total"))
    # A stretch counts in every later fold: at most folds + 1 copies of a sum, not of a row.
    later = sums.select(*by, "cell", "total", F.explode(F.sequence(F.col("stretch") + 1, F.lit(folds + 1))).alias("fold"))
    added = later.groupBy(*by, "fold", "cell").agg(F.sum("total").alias("total"))
    listed = F.sort_array(F.collect_list(F.struct("cell", "total")))
    return added.groupBy(*by, "fold").agg(F.transform(listed, lambda c: c["total"]).alias("sums"))


def solved(sums: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The weights of many systems given as rows of sums; of several solutions the shortest."""
    m = len(penalty)
    square = sums.reshape(-1, m + 1, m + 1)
    left, right = square[:, :m, :m] + np.diag(penalty), square[:, :m, m]
    return np.einsum("kij,kj->ki", np.linalg.pinv(left, rcond=RANK, hermitian=True), right)


def weights_of(sums: str, penalty: Sequence[float]) -> Column:
    """The weights of every row's system, with a penalty on the square of each weight."""
    penalties = np.array(penalty, float)

    @pandas_udf("array<double>")
    def solve(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(solved(np.stack(part.to_numpy()).astype(float), penalties))) if len(part) else pd.Series([], dtype=object)

    return solve(F.col(sums))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
