"""Intermediate tables in the shared folder of the cluster.

A stored table cuts lineage on storage that outlives executors, is computed once however often it is read,
and gives the planner its true size: below ``spark.sql.autoBroadcastJoinThreshold`` Spark broadcasts it,
above it the join is a sort-merge whose two inputs are plain shuffles, which AQE can split on a hot key.

A job discards what only its own stored tables were made from; ``discard_all`` removes whatever a session has left.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


_local_dirs: dict[str, str] = {}
_kept: dict[str, dict[tuple[str, ...], DataFrame]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="palmares-")
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/palmares/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of rows that a task passes to its Python worker together in writes that say so.
BATCH_BYTES = 1 << 22


@contextmanager
def _option(spark: SparkSession, key: str, value: int) -> Iterator[None]:
    """A session option that holds in this block. A value that the session has set itself stays."""
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key)


def open_folders(spark: SparkSession, most: int = 8) -> AbstractContextManager[None]:
    """Partitioned writes in this block keep the files of up to ``most`` folders open in each task.

    Spark otherwise sorts all rows of a task by folder first, as rows of memory: many times the size of the file split that
    they come from. Rows of folders beyond ``most`` are still sorted. A number that the session has set itself holds.
    """
    return _option(spark, "spark.sql.maxConcurrentOutputFileWriters", most)


def narrow_batches(spark: SparkSession, most: int = BATCH_BYTES) -> AbstractContextManager[None]:
    """Writes in this block pass rows to Python workers ``most`` bytes at a time, or a single row.

    Spark otherwise gathers 10,000 rows, up to 64 MB of whole texts, and both the executor and its worker hold them.
    """
    return _option(spark, "spark.sql.execution.arrow.maxBytesPerBatch", most)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Writes in this block delete their shuffle files when they are done, not when the driver collects its garbage."""
    return _option(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def stored(df: DataFrame, label: str = "table", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return the frame that reads it back.

    A filter on a column of ``partition_by`` then skips whole folders.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with open_folders(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned. Whatever was made from them must be stored itself by then, so that a lost
    executor needs them no more."""
    for df in tables:
        _delete(df.sparkSession, df.stored_path)


def discard_part(df: DataFrame, folder: str) -> None:
    """Delete a folder of a table that ``stored`` has partitioned; nothing may read it any more."""
    _delete(df.sparkSession, f"{df.stored_path}/{folder}")


def stored_once(spark: SparkSession, key: tuple[str, ...], build: Callable[[], DataFrame], refresh: bool = False, partition_by: Sequence[str] = ()) -> DataFrame:
    """The table of this session and key, written at first use; ``refresh`` replaces it."""
    mine = _kept.setdefault(spark.sparkContext.applicationId, {})
    if refresh or key not in mine:
        old = mine.get(key)
        mine[key] = stored(build(), key[-1], partition_by)
        if old is not None:
            discard(old)
    return mine[key]


def discard_all(spark: SparkSession) -> None:
    """Delete every table that this session has stored. Frames that read one of them can run no more."""
    app = spark.sparkContext.applicationId
    _kept.pop(app, None)
    _delete(spark, f"{shared_dir(spark)}/palmares/{app}")
