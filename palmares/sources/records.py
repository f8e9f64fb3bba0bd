"""CSV records whose quoted cells hold line breaks, from files that stay splittable.

Whether a line starts inside a quoted cell depends on the number of quotes before it in the file. Quotes are counted by split,
the counts of former splits are added up, and each split counts on from there, line after line. Lines outside of quotes are
records as they are; only the lines of a record with breaks meet again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palmares.store import stored

#: Lines of one record; a quote that is never closed would take the rest of its file.
MOST_LINES = 10_000
LINES = "file string, split long, line long, quotes long, text string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, text) of every line, without its line feed; ``split`` is where the part of the file starts."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("text"))


def quotes(text: str = "text"):
    return F.length(text) - F.length(F.replace(F.col(text), F.lit('"'), F.lit("")))


def has_breaks(spark: SparkSession, path: str) -> bool:
    """Whether any line has an odd number of quotes, which is so if and only if a quoted cell holds a line break."""
    return not lines(spark, path).filter(quotes() % 2 == 1).limit(1).isEmpty()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each split and count the quotes before each. A task reads its splits one after the other."""
    place, line, seen = None, 0, 0
    for batch in batches:
        names, splits = batch.column(0), batch.column(1).to_numpy()
        inside = pc.count_substring(batch.column(2), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        same = np.ones(len(splits), bool)
        if len(splits):
            codes = names.dictionary_encode().indices.to_numpy()
            same[1:] = (splits[1:] == splits[:-1]) & (codes[1:] == codes[:-1])
            same[0] = place == (names[0].as_py(), splits[0])
            place = (names[len(splits) - 1].as_py(), splits[-1])
        before, number = np.cumsum(inside) - inside, np.arange(len(splits))
        # What a stretch of one split has before it: nothing for a new split, what was seen for the one that goes on.
        starts = np.flatnonzero(~same)
        base_quotes, base_line = np.full(len(splits), -seen), np.full(len(splits), -line)
        for start, end in zip(starts, [*starts[1:], len(splits)]):
            base_quotes[start:end], base_line[start:end] = before[start], number[start]
        quoted, numbered = before - base_quotes, number - base_line
        if len(splits):
            seen, line = int(quoted[-1] + inside[-1]), int(numbered[-1] + 1)
        yield pa.RecordBatch.from_arrays([names, batch.column(1), pa.array(numbered, pa.int64()), pa.array(quoted, pa.int64()), batch.column(2)], names=["file", "split", "line", "quotes", "text"])


def records(spark: SparkSession, path: str, most_lines: int = MOST_LINES) -> DataFrame:
    """(file, first, text): the records of all files with their line breaks; ``first`` marks the first of a file.

    A carriage return before the line feed that ends a record is left out, one inside a cell is kept. Empty lines are no records. A
    record of over ``most_lines`` lines raises, which is what a quote that is never closed comes to.
    """
    every = lines(spark, path)
    sums = every.groupBy("file", "split").agg(F.sum(quotes()).alias("held"))
    former = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.select("file", "split", F.coalesce(F.sum("held").over(former), F.lit(0)).alias("former")), "quotes")
    at = every.mapInArrow(_counted, LINES).join(sums, ["file", "split"])
    before = (F.col("former") + F.col("quotes")) % 2 == 1
    at = at.select("file", "split", "line", "text", before.alias("inside"), (before != (quotes() % 2 == 1)).alias("open"))
    first = (F.col("split") == 0) & (F.col("line") == 0)
    whole = at.filter(~F.col("inside") & ~F.col("open")).select("file", first.alias("first"), "text")
    # The parts of broken records: numbered by the starts before them, within a split and by the splits before it.
    parts = stored(at.filter(F.col("inside") | F.col("open")), "broken-lines")
    starts = parts.groupBy("file", "split").agg(F.count_if(~F.col("inside")).alias("begun"))
    starts = starts.select("file", "split", F.coalesce(F.sum("begun").over(former), F.lit(0)).alias("earlier"))
    upto = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("within", F.sum(F.when(~F.col("inside"), 1).otherwise(0)).over(upto)).join(starts, ["file", "split"])
    parts = parts.withColumn("record", F.col("earlier") + F.col("within"))
    longest = parts.groupBy("file", "record").count().agg(F.max("count")).first()[0] or 0
    if longest > most_lines:
        raise ValueError(f"a record of {longest} lines in {path}: is a quote not closed?")
    in_order = F.sort_array(F.collect_list(F.struct("split", "line", "text")))
    joined = parts.groupBy("file", "record").agg(
        F.max(first & ~F.col("inside")).alias("first"), F.array_join(F.transform(in_order, lambda p: p["text"]), "\n").alias("text")
    )
    both = whole.unionByName(joined.select("file", "first", "text"))
    return both.withColumn("text", F.regexp_replace("text", "\r$", "")).filter(F.col("text") != "")
