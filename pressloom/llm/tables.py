"""Reading tables and cutting lineage in storage that every executor sees."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def small_batches(spark: SparkSession) -> None:
    """Bound what goes to a Python worker at once, by rows and bytes: texts and sets of shingles are wide."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none: a temporary one, if everything runs on this
    machine; on a cluster no executor would see it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = tempfile.mkdtemp(prefix="pressloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Where settle() notes the folders that it writes, if it runs inside noted(): each thread and task has its own.
_notes: ContextVar[list[str] | None] = ContextVar("_notes", default=None)


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: later jobs start there when an executor is lost."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/pressloom-{uuid.uuid4().hex}"
    if (notes := _notes.get()) is not None:
        notes.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders in the shared storage, whatever file system it is."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of what is settled inside; nothing is deleted."""
    made: list[str] = []
    before = _notes.set(made)
    try:
        yield made
    finally:
        _notes.reset(before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What is settled inside is deleted at the end, but for paths that are taken out of the list."""
    with noted() as made:
        try:
            yield made
        finally:
            discard(spark, *made)


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, settled. The tables that it settled on its way are deleted: nothing but its result read them."""
    with scratch(spark) as made:
        out = settle(make())
        path = made.pop()
    if (notes := _notes.get()) is not None:
        notes.append(path)
    return out


def width(spark: SparkSession) -> int:
    """Number of partitions for an explicit exchange: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
