"""Cutting lineage in storage that every executor sees."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The checkpoint folder of the session (spark.checkpoint.dir). Where none is named, a local session gets a temporary one; on a cluster
    that is an error, as executors wouldn't see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = tempfile.mkdtemp(prefix="pressloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed and kept in the checkpoint folder: later jobs start there when an executor is lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()
