"""Named tables and databases of the session catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from palmares.store import open_folders


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a database if it is missing, in ``location`` or in the warehouse of the session."""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{place}")


def database_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.databaseExists(name)


def list_databases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES").select(F.col("namespace").alias("database"))


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN `{database}`").filter(~F.col("isTemporary")).select(
        F.col("namespace").alias("database"), F.col("tableName").alias("table")
    )


def drop_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")


def append_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    with open_folders(df.sparkSession):
        df.write.mode("append").format("parquet").partitionBy(*partition_by).saveAsTable(name)


def overwrite_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    with open_folders(df.sparkSession):
        df.write.mode("overwrite").format("parquet").partitionBy(*partition_by).saveAsTable(name)


def peek(spark: SparkSession, name: str, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """A few rows of a table: the first by ``order``, any ones without it."""
    rows = spark.table(name)
    return (rows.orderBy(*order) if order else rows).limit(n)
