"""Intermediate tables in the folder that the whole cluster shares.

A written table cuts the lineage and survives lost executors. The folder is
`spark.checkpoint.dir`; where a local session has none (tests on one machine), a
temporary folder of this process is used. On a cluster it must be set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: How often tables have been cleared; what remembers tables forgets them when this moves.
cleared = 0


def folder(spark: SparkSession) -> str:
    """The shared folder for this application's intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="scratch-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


#: Rows of a few longs that one task handles, where a step asks for `tasks`.
ROWS = 1 << 16


def tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for so many narrow rows: one a core, more if there are more than ROWS rows for each."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


#: Whether a query's shuffle files are deleted as it ends, and not only when the driver collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A table that is written needs no shuffle files any more; the session's own choice holds again afterwards."""
    was = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if was is None else spark.conf.set(FREED, was)


def keep(df: DataFrame, name: str, fewer: bool = False, options: dict[str, str] | None = None, most: int | None = None) -> DataFrame:
    """Write df once under a fresh path and return the written table; options: further ones of the writer.

    fewer: dealt anew after it is computed, into as many files as its size asks for; for
    narrow tables much smaller than what they are made of, unless a shuffle ends their plan anyway.
    most: tasks of the last step, and so files, at most (see `tasks`); partitions are put
    together for that, not dealt anew.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if fewer:
        df = df.hint("rebalance")
    if most:
        df = df.coalesce(most)
    with _shuffles_freed(spark):
        df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, table: DataFrame) -> None:
    """Delete a table that `keep` gave and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results not yet consumed become unreadable."""
    global cleared
    cleared += 1
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
