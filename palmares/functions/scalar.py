"""Scalar helpers over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def word(column: str | Column, position: int, separator: str = " ") -> Column:
    """The word at ``position`` (from 0), null when there are fewer words."""
    return F.get(F.split(column, separator), F.lit(position))


def decorated(label: str | Column, detail: str | Column) -> Column:
    """``label (detail)``."""
    return F.concat(label, F.lit(" ("), detail, F.lit(")"))


def century(year: str | Column) -> Column:
    """19, 20 or 21 for the years 1801 to 2100, else null."""
    y = F.col(year) if isinstance(year, str) else year
    return F.when(y.between(1801, 2100), F.ceil(y / 100).cast("int"))


def body_mass_index(weight: str, height: str) -> Column:
    """Kilograms over squared metres, from kilograms and centimetres; null for a height of 0."""
    return F.try_divide(F.col(weight), F.pow(F.col(height) / 100, F.lit(2)))


def cyclic(year: str | Column, top: Column) -> tuple[Column, Column]:
    """Sine and cosine of the year as a share of a full turn at ``top``."""
    y = F.col(year) if isinstance(year, str) else year
    angle = F.lit(2 * math.pi) * y / top
    return F.sin(angle), F.cos(angle)


def new_year(year: str | Column) -> Column:
    """1 January of an integer year."""
    return F.make_date(F.col(year) if isinstance(year, str) else year, F.lit(1), F.lit(1))


def round_even(column: Column, digits: int) -> Column:
    """Round by scaling to the nearest integer, ties to even."""
    scale = 10.0**digits
    return F.rint(column * scale) / scale


def stable_mean(column: str | Column) -> Column:
    """The mean to twelve decimals, summed as decimals so that no order of the rows changes a bit; NaN counts as missing.

    Values must be below 1e12.
    """
    value = F.col(column) if isinstance(column, str) else column
    return F.avg(value.try_cast("decimal(24,12)")).cast("double")


def salted_hash(columns: list[str | Column], seed: int) -> Column:
    """A 60-bit hash of a row key and a seed, from MD5, so that any engine can repeat it."""
    key = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
