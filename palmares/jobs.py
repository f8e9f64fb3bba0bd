"""Batch jobs between named tables: load the fact file, prepare it, export the result."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from palmares.plans.etl import prepare
from palmares.schemas import CONTINENT_NAMES, DEFAULT_CONTINENT
from palmares.sources.files import export_csv, read_fact_csv, read_lookup_csv
from palmares.sources.tables import append_table, create_database, overwrite_table


def load(spark: SparkSession, fact_csv: str, database: str, table: str = "participation_raw") -> None:
    """Append the fact file to a named table, creating the database at need."""
    create_database(spark, database)
    append_table(read_fact_csv(spark, fact_csv), f"{database}.{table}")


def prepare_table(
    spark: SparkSession,
    database: str,
    lookup_csv: str,
    source: str = "participation_raw",
    target: str = "participation",
    export_path: str | None = None,
    names: Mapping[str, str] = CONTINENT_NAMES,
    default: str = DEFAULT_CONTINENT,
) -> None:
    """Overwrite the prepared table, partitioned by century, and optionally export it as CSV."""
    rows = prepare(spark.table(f"{database}.{source}"), read_lookup_csv(spark, lookup_csv), names, default)
    overwrite_table(rows, f"{database}.{target}", ["century"])
    if export_path:
        export_csv(spark.table(f"{database}.{target}"), export_path, "overwrite")
