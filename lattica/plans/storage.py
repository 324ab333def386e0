"""Intermediate tables in the shared folder, so that iterations stay short and survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a temporary folder becomes it on a local master, as in tests; on a cluster that is refused, as
    executors would not see each other's files.
    """
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = f"file://{tempfile.mkdtemp(prefix='lattica-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables stored within a `scratch` after which ended plans are collected: the driver's heap does not grow over them.
FORGET = 4

#: (path, table) of what is stored within the innermost `scratch`.
_SCRATCH: ContextVar[list | None] = ContextVar("scratch", default=None)


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """df written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if (made := _SCRATCH.get()) is not None:
        made.append((path, table))
        if len(made) % FORGET == 0:
            forget(spark)
    return table


def forget(spark: SparkSession) -> None:
    """Shuffle files of what has ended go from all executors once the driver's JVM has collected their plans, which it may put off for long."""
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored within are deleted at the end, but those that the function it gives is called with."""
    made, kept = [], []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    mark = _SCRATCH.set(made)
    try:
        yield keep
    finally:
        _SCRATCH.reset(mark)
        for path, table in made:
            if not any(table is k for k in kept):
                context = table.sparkSession.sparkContext
                at = context._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
            elif (outer := _SCRATCH.get()) is not None:
                outer.append((path, table))
