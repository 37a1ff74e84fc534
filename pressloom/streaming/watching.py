"""Rows that a stream can't take, kept beside it with the reason, and how a running stream is doing, as a table."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import timing

#: Fixed value: minutes that a row may be ahead of the clock.
EARLY_MINUTES = 15
PROGRESS = "query string, run string, batch long, started timestamp, seen timestamp, rows long, state_rows long, dropped_late long, watermark timestamp, error string"


def refusal(ts: Column, clock: Column, newest: Column, late: str) -> Column:
    """Why a row isn't taken: no time, ahead of the clock, or older than the newest row of earlier batches allows; null if it is."""
    return (
        F.when(ts.isNull(), "undated").when(F.unix_micros(ts) > F.unix_micros(clock) + EARLY_MINUTES * 60_000_000, "ahead")
        .when(ts < newest - F.expr(f"INTERVAL {late}"), "late")
    )


def write_sorted_out(rows: DataFrame, folder: str, checkpoint: str, late: str = "2 hours", clock: str = "seen") -> StreamingQuery:
    """Append streaming `rows` (ts, `clock`, ...) to `folder`/taken, those that can't be taken to `folder`/refused with a `reason`.

    A row is late by the newest taken row of the batches before its own, which is one row that each batch hands to the next;
    no batch reads what others wrote. A batch that runs again replaces its own folders.
    """
    spark = rows.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        before = spark.read.schema("newest timestamp").parquet(f"{folder}/clock/b={epoch - 1}") if epoch else spark.createDataFrame([(None,)], "newest timestamp")
        judged = batch.join(F.broadcast(before), F.lit(True)).withColumn("reason", refusal(F.col("ts"), F.col(clock), F.col("newest"), late))
        taken = judged.where("reason is null")
        taken.select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/taken/b={epoch}")
        judged.where("reason is not null").select(*batch.columns, "reason").write.mode("overwrite").parquet(f"{folder}/refused/b={epoch}")
        own = spark.read.schema(batch.schema).parquet(f"{folder}/taken/b={epoch}").agg(F.max("ts").cast("timestamp").alias("newest"))
        own.unionByName(before).agg(F.max("newest").alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/clock/b={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Notes each batch of the session's streams, the last `most` of them; a stream that ends with an error adds a row with it."""

    def __init__(self, most: int = 10_000):
        self.rows: deque[tuple] = deque(maxlen=most)

    def onQueryStarted(self, event: StreamingQueryListener.QueryStartedEvent) -> None:
        self.rows.append((event.name, str(event.runId), None, event.timestamp, event.timestamp, 0, None, None, None, None))

    def onQueryProgress(self, event: StreamingQueryListener.QueryProgressEvent) -> None:
        p = event.progress
        states = p.stateOperators or []
        held = sum(s.numRowsTotal for s in states), sum(s.numRowsDroppedByWatermark for s in states)
        self.rows.append((p.name, str(p.runId), p.batchId, None, p.timestamp, p.numInputRows, *held, (p.eventTime or {}).get("watermark"), None))

    def onQueryIdle(self, event: StreamingQueryListener.QueryIdleEvent) -> None:
        self.rows.append((None, str(event.runId), None, None, event.timestamp, 0, None, None, None, None))

    def onQueryTerminated(self, event: StreamingQueryListener.QueryTerminatedEvent) -> None:
        if event.exception:
            self.rows.append((None, str(event.runId), None, None, None, 0, None, None, None, event.exception[:500]))

    def table(self, spark: SparkSession) -> DataFrame:
        """What was noted: a row for each event."""
        text = PROGRESS.replace("timestamp", "string")
        times = {c: F.col(c).cast("timestamp") for c in ("started", "seen", "watermark")}
        return spark.createDataFrame(list(self.rows), text).withColumns(times)


def stream_health(progress: DataFrame, as_of: Column, enabled: Column | None = None) -> DataFrame:
    """For each run: its name, batches, rows, rows that came too late, last batch or sign of life, its last error, and its health at `as_of`."""
    last = progress.groupBy("run").agg(
        F.max("query").alias("query"), F.count("batch").alias("batches"), F.sum("rows").alias("rows"), F.sum(F.coalesce("dropped_late", F.lit(0))).alias("dropped_late"),
        F.max("seen").alias("seen"), F.max("watermark").alias("watermark"), F.max("error").alias("error"),
    )
    health = timing.health(F.col("seen"), F.lit(True) if enabled is None else enabled, as_of)
    status = F.when(F.col("error").isNotNull(), "failed").otherwise(health["status"])
    return last.select("*", status.alias("status"), health["delay_minutes"].alias("delay_minutes"))
