"""Streams of the desk: items accepted in time and once, rows that come too late, the bounded live view, revisions, stages.
Shown events and quotas are in `pulses`, as keyed state.

A global ranking can't run inside a stream, so foreachBatch recomputes the small view (rows of the last two
hours, twelve at most) from the old view and the new rows; a batch that comes again changes nothing. Every version is written
under the number of its batch, so a batch that runs again after a failure replaces what it wrote.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Rows of the view, hours that an event stays shown, minutes ahead and hours of age that are accepted.
LIMIT, SHOWN_HOURS, EARLY_MINUTES, AGE_HOURS = 12, 8, 15, 18


def accepted(rows: DataFrame, late: str = "2 hours", clock: str = "seen") -> DataFrame:
    """Streaming `rows` (id, published, `clock`: both timestamps) not older than AGE_HOURS nor far ahead when seen, each id once.

    A row without a date is taken as published when it was seen. State is kept as long as `late` rows may come.
    """
    age = F.unix_seconds(clock) - F.unix_seconds("published")
    fine = rows.where(F.col("published").isNull() | age.between(-EARLY_MINUTES * 60, AGE_HOURS * 3600))
    return fine.withColumn("event_time", F.coalesce("published", clock)).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["id"])


def _once(hours: int):
    gap = pd.Timedelta(hours=hours)

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "id"])
        there, keep, last = sorted(rows.loc[rows["shown"], "ts"]), [], None
        for at, shown in zip(rows["ts"], rows["shown"]):
            i = bisect_left(there, at)
            near = (i < len(there) and there[i] - at < gap) or (i > 0 and at - there[i - 1] < gap) or (last is not None and at - last < gap)
            keep.append(not shown and not near)
            last = at if keep[-1] else last
        return rows[keep].drop(columns="shown")

    return run


def first_of_event(shown: DataFrame, batch: DataFrame, hours: int = SHOWN_HOURS) -> DataFrame:
    """Rows of `batch` (id, ts, event_key, ...) to show: in order of time, not within `hours` of one of their event that is shown, be it
    before or, as rows may come late, after them.

    `shown`: rows shown before, of the same columns; those beside the batch's own times are looked at. The order within an event decides, so each
    event's rows of one batch are folded together (operators.thinning does whole tables). Rows without a key are all shown.
    """
    span = batch.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    beside = F.col("ts").between(F.col("low") - F.expr(f"INTERVAL {hours} HOURS"), F.col("high") + F.expr(f"INTERVAL {hours} HOURS"))
    old = shown.join(F.broadcast(span), F.lit(True)).where(beside).select(*batch.columns)
    rows = old.withColumn("shown", F.lit(True)).unionByName(batch.withColumn("shown", F.lit(False))).where("event_key is not null")
    folded = rows.groupBy("event_key").applyInPandas(_once(hours), batch.select(*[c for c in rows.columns if c != "shown"]).schema)
    return folded.select(*batch.columns).unionByName(batch.where("event_key is null"))


def current(log: DataFrame) -> DataFrame:
    """The latest revision of each event from an append-only log (event, revision, stage, body)."""
    return log.groupBy("event").agg(F.max_by(F.struct("revision", "stage", "body"), "revision").alias("x")).select("event", "x.*")


def run_stages(spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[DataFrame | None], DataFrame]]]) -> list[str]:
    """Run `stages` one after the other, each on its predecessor's output; one whose output is complete in `folder` isn't run again.
    Returns the names of those that ran."""
    ran, rows = [], None
    for name, stage in stages:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            stage(rows).write.mode("overwrite").parquet(f"{folder}/{name}")
            ran.append(name)
        rows = spark.read.parquet(f"{folder}/{name}")
    return ran


def merged(view: DataFrame, batch: DataFrame, limit: int = LIMIT) -> DataFrame:
    rows = view.unionByName(batch).dropDuplicates(["id"])
    latest = rows.agg(F.max("ts").alias("as_of"))
    recent = rows.join(F.broadcast(latest), F.lit(True)).where("ts >= as_of - INTERVAL 2 HOURS").drop("as_of")
    return recent.orderBy(F.desc("ts"), F.desc_nulls_last("priority"), F.desc("id")).limit(limit)


def keep_live(spark: SparkSession, rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start keeping the view of streaming `rows` (id, ts, priority) in `folder`, one version a batch; the last two stay, as
    a batch that runs again after a failure reads the one before its own."""
    schema = rows.schema

    def write(batch: DataFrame, epoch: int) -> None:
        before = spark.read.schema(schema).parquet(f"{folder}/v={epoch - 1}") if epoch else spark.createDataFrame([], schema)
        merged(before, batch).coalesce(1).write.mode("overwrite").parquet(f"{folder}/v={epoch}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={epoch - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
