"""Seeded splits, exact samples and time-ordered folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FractionalType

from palmares.functions.scalar import salted_hash
from palmares.store import stored


def _hashed(df: DataFrame, keys: Sequence[str], seed: int) -> Column:
    """The hash of the key. Fractions count to six decimals, so that a last bit moves no row."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return salted_hash([F.col(k).try_cast("decimal(24,6)") if isinstance(kinds[k], FractionalType) else F.col(k) for k in keys], seed)


def split(df: DataFrame, keys: Sequence[str], train_pct: int, seed: int = 42, target: str = "part") -> DataFrame:
    """Mark every row ``train`` or ``test`` by a hash of its key: the same key always falls on the same side."""
    train = _hashed(df, keys, seed) % 100 < train_pct
    return df.withColumn(target, F.when(train, F.lit("train")).otherwise(F.lit("test")))


def exact_samples(df: DataFrame, keys: Sequence[str], pcts: Sequence[int], seed: int = 42, digit_bits: int = 10, few: int = 1024) -> dict[int, DataFrame]:
    """For each percentage exactly ``floor(rows * pct / 100)`` rows: the first by hash of their unique key, then by the key.

    The rows are stored with their place in that order, so the input is read once for all samples; the boundary is then found
    digit by digit. Each level counts the rows of the boundary's digit so far by the next digit, at most ``2 ** digit_bits``
    numbers for the driver. Only the last ``few`` rows around the boundary are sorted (more only where hashes are equal).
    Samples of one seed contain each other.
    """
    hashed = _hashed(df, keys, seed)
    # The order of former versions: by the last 20 of the 60 bits, then by the others.
    place = F.shiftleft(hashed.bitwiseAND((1 << 20) - 1), 40).bitwiseOR(F.shiftright(hashed, 20))
    rows = stored(df.withColumn("_place", place), "placed")
    counts: dict[tuple[int, int], dict[int, int]] = {}

    def by_digit(low: int, shift: int, bits: int) -> dict[int, int]:
        """Counts of the rows within ``bits`` digits above ``shift`` of the prefix that starts at ``low``."""
        if (low, shift) not in counts:
            part = rows.filter(F.col("_place").between(low, low + (1 << (shift + bits)) - 1)) if shift + bits < 60 else rows
            digit = F.shiftright(F.col("_place") - low, shift)
            counts[low, shift] = {r["digit"]: r["n"] for r in part.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()}
        return counts[low, shift]

    def first(pct: int) -> DataFrame:
        low, shift = 0, 60 - digit_bits
        sizes = by_digit(0, shift, digit_bits)
        rest = sum(sizes.values()) * pct // 100
        while True:
            inside = 0
            for digit in sorted(sizes):
                inside = sizes[digit]
                if rest < inside:
                    low += digit << shift
                    break
                rest -= inside
            else:
                # The boundary lies behind the last row of this prefix.
                return rows.filter(F.col("_place") <= low + (max(sizes, default=0) << shift) + (1 << shift) - 1)
            if rest == 0:
                return rows.filter(F.col("_place") < low)
            if inside <= few or shift == 0:
                edge = rows.filter(F.col("_place").between(low, low + (1 << shift) - 1))
                return rows.filter(F.col("_place") < low).unionByName(edge.orderBy("_place", *keys).limit(rest))
            bits = min(digit_bits, shift)
            shift -= bits
            sizes = by_digit(low, shift, bits)

    return {pct: first(pct).drop("_place") for pct in pcts}


def exact_sample(df: DataFrame, keys: Sequence[str], pct: int, seed: int = 42, digit_bits: int = 10, few: int = 1024) -> DataFrame:
    """One of ``exact_samples``."""
    return exact_samples(df, keys, [pct], seed, digit_bits, few)[pct]


def time_folds(series: DataFrame, time: str, folds: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Expanding-window folds of a series with one row per ``time``.

    The last ``folds`` blocks of ``n // (folds + 1)`` rows are the test parts in turn; all rows before a block
    train it. The rows of a series with fewer than ``folds + 1`` have a null fold and the role ``too_short``. One row per
    period is expected, so that the window of one series is short.
    """
    ordered = Window.partitionBy(*by).orderBy(time)
    numbered = series.withColumns({
        "_at": F.row_number().over(ordered) - 1,
        "_n": F.count(F.lit(1)).over(Window.partitionBy(*by)),
    })
    size = F.floor(F.col("_n") / (folds + 1)).cast("int")
    every = F.when(F.col("_n") > folds, F.sequence(F.lit(1), F.lit(folds)))
    spread = numbered.withColumn("fold", F.explode_outer(every))
    start = F.col("_n") - (folds + 1 - F.col("fold")) * size
    role = F.when(F.col("fold").isNull(), F.lit("too_short")).when(F.col("_at") < start, F.lit("train")).when(F.col("_at") < start + size, F.lit("test"))
    return spread.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_at", "_n")
