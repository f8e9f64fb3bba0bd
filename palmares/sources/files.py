"""File sources and sinks: Parquet tables, the CSV fact, the CSV lookup, CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from palmares.schemas import LOOKUP, RAW
from palmares.sources.records import has_breaks, records

NON_BREAKING_SPACE = "\u00a0"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


CSV = {"escape": '"', "nullValue": "NA"}


def _columns(spark: SparkSession, path: str, schema: T.StructType) -> list[str]:
    """The header's names; a column of the schema that it lacks raises."""
    found = spark.read.option("header", True).option("escape", '"').csv(path).columns
    if missing := [f.name for f in schema.fields if f.name.lower() not in {c.lower() for c in found}]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return found


def _cells(spark: SparkSession, path: str, found: list[str], kind: T.StructType, strict: bool) -> DataFrame:
    """All columns of the file by ``kind``, with cells that hold line breaks whole."""
    options = CSV | {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    if not has_breaks(spark, path):
        return spark.read.options(header=True, **options).schema(kind).csv(path)
    parsed = records(spark, path).filter(~F.col("first")).select(F.from_csv("text", _ddl(kind), options).alias("row"))
    return parsed.select(*[F.col("row").getField(f.name).alias(f.name) for f in kind.fields])


def _ddl(kind: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kind.fields)


def read_fact_csv(spark: SparkSession, path: str, schema: T.StructType = RAW, strict: bool = False) -> DataFrame:
    """The fact file: header row, declared types, ``NA`` and empty cells become null.

    Columns are taken by their names in the header, in any order; a missing one raises. Quotes inside a quoted cell are
    doubled, and a quoted cell may hold line breaks. A cell that is not of its type becomes null, or raises with ``strict``;
    ``bad_cells`` counts them. The header itself is one line.
    """
    declared = {f.name.lower(): f for f in schema.fields}
    found = _columns(spark, path, schema)
    own = T.StructType([declared.get(c.lower(), T.StructField(c, T.StringType())) for c in found])
    frame = _cells(spark, path, found, own, strict)
    strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return frame.select(*schema.names).withColumns({c: F.nullif(F.col(c), F.lit("")) for c in strings})


def bad_cells(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """(column, n, n_missing, n_bad): per declared column the rows, the missing cells, and those that are not of its type."""
    found = _columns(spark, path, schema)
    cells = _cells(spark, path, found, T.StructType([T.StructField(c, T.StringType()) for c in found]), False)
    by_name = {c.lower(): c for c in found}
    counts = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(schema.fields):
        text = F.nullif(F.col(f"`{by_name[f.name.lower()]}`"), F.lit(""))
        counts += [F.count_if(text.isNull()).alias(f"m{i}"), F.count_if(text.isNotNull() & text.try_cast(f.dataType).isNull()).alias(f"b{i}")]
    rows = [F.struct(F.lit(f.name).alias("column"), F.col("n"), F.col(f"m{i}").alias("n_missing"), F.col(f"b{i}").alias("n_bad")) for i, f in enumerate(schema.fields)]
    return cells.agg(*counts).select(F.inline(F.array(*rows)))


def clean_lookup(lookup: DataFrame, key: str = "ioc", value: str = "continent", blank: str = "NA") -> DataFrame:
    """Drop blank and non-breaking-space keys, read a blank value as ``blank``, keep one row per key."""
    code = F.trim(F.translate(F.col(key), NON_BREAKING_SPACE, " "))
    return (
        lookup.select(code.alias(key), F.coalesce(F.nullif(F.trim(F.col(value)), F.lit("")), F.lit(blank)).alias(value))
        .filter(F.col(key) != "")
        .groupBy(key)
        .agg(F.min(value).alias(value))
    )


def read_lookup_csv(spark: SparkSession, path: str, schema: T.StructType = LOOKUP) -> DataFrame:
    """The code lookup. ``NA`` is a continent code here, so no null value is declared."""
    return clean_lookup(spark.read.schema(schema).option("header", True).csv(path))


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, one file per partition; nulls as ``NA`` so that the fact reader restores them."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(header=True, **CSV, **spaces).csv(path)
