"""Shared pieces of the corpus operators.

Operators first pack the columns a caller wants back into one struct, so that no column of the input can clash
with a working column; ``unpacked`` lays them out again and lets the added columns win over equal names.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 1 << 20
#: Bytes of text that a task turns into Python objects at once; one longer text is taken alone.
SLICE_BYTES = 1 << 21

_kept_by_worker: list[Callable] = []


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())


def n_words(column: str | Column) -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def packed(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def unpacked(df: DataFrame, row: str, added: Sequence[str]) -> DataFrame:
    """The fields of ``row`` but for those named like an added column, then the added columns."""
    names = {a.lower() for a in added}
    kept = [f for f in df.schema[row].dataType.fieldNames() if f.lower() not in names]
    return df.select(*[F.col(row).getField(f).alias(f) for f in kept], *added)


def running_start(df: DataFrame, amount: str, order: str, target: str, by: Sequence[str] = (), block: int = 4096) -> DataFrame:
    """The sum of ``amount`` over all rows of the group with a smaller ``order`` (a dense whole number).

    Two levels: rows are summed within blocks of ``block`` numbers, and only block totals meet in one task.
    """
    blocks = df.withColumn("_block", F.floor(F.col(order) / block))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(*by, "_block").agg(F.sum(amount).alias("_sum"))
    totals = totals.select(*by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = blocks.withColumn("_within", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return within.join(totals, [*by, "_block"]).withColumn(target, F.col("_before") + F.col("_within")).drop("_block", "_before", "_within")


def kept_by_worker(cached: Callable) -> Callable:
    """Mark an ``lru_cache`` whose values a Python worker keeps between tasks, until tasks of other operators ``let_go``."""
    _kept_by_worker.append(cached)
    return cached


def let_go() -> None:
    """Drop what earlier tasks of other operators have left in this Python worker."""
    for cached in _kept_by_worker:
        cached.cache_clear()


def give_back() -> None:
    """Return the memory that this Python worker has freed to the system; the worker waits for tasks long after this one."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def gives_back(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over whole texts that does not leave their memory with its worker."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def slices(batch: pa.RecordBatch, text: pa.Array, most: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Runs of rows of ``batch`` with their texts, ``most`` bytes of text together or a single row."""
    start = total = 0
    most = most or SLICE_BYTES
    for at, size in enumerate(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
        if at > start and total + size > most:
            yield batch.slice(start, at - start), text.slice(start, at - start).to_pylist()
            start, total = at, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start), text.slice(start).to_pylist()


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of narrow rows whose counted size is at most ``BROADCAST_ROWS``; larger ones stay plain joins."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
