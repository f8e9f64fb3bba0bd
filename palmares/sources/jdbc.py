"""JDBC table scan and sink. Credentials and driver come from the caller's options, never from code."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Split:
    """Range of a numeric or date column over which the scan is divided into parallel queries."""

    column: str
    lower: str
    upper: str
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": self.lower,
            "upperBound": self.upper,
            "numPartitions": str(self.partitions),
        }


def scan_options(url: str, dbtable: str, options: Mapping[str, str], split: Split | None = None) -> dict[str, str]:
    return {"url": url, "dbtable": dbtable, **options, **(split.options() if split else {})}


def read_jdbc(
    spark: SparkSession, url: str, dbtable: str, options: Mapping[str, str], split: Split | None = None
) -> DataFrame:
    """Scan a database table; without ``split`` it is one partition, with it ``split.partitions`` queries."""
    return spark.read.format("jdbc").options(**scan_options(url, dbtable, options, split)).load()


def write_jdbc(df: DataFrame, url: str, dbtable: str, options: Mapping[str, str], mode: str = "append") -> None:
    """Append to (or ``mode="overwrite"``) a database table from the executors."""
    df.write.format("jdbc").options(**scan_options(url, dbtable, options)).mode(mode).save()
