"""Time and number queries: labels of rows, health of the pulse and the watch, waits before retries, written quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timing as T
from ..sources.tables import pick, table, with_latest

SYMBOLS = ["OSEBX", "EURNOK", "NOKPOLICY", "GOLD"]


def time_labels(spark: SparkSession, d: str) -> DataFrame:
    e = with_latest(table(spark, d, "events"))
    return e.select(F.col("event_id").alias("id"), T.is_open(F.col("ts")).alias("open"), T.relative(F.col("ts"), F.col("as_of")).alias("said"), T.clock(F.col("ts")).alias("clock"), T.full_date(F.col("ts")).alias("full_date"))


def pulse_health(spark: SparkSession, d: str) -> DataFrame:
    """Health as of each event, with the last success some minutes earlier, or never."""
    i = F.col("event_id")
    e = table(spark, d, "events").select(i.alias("id"), "ts", (i % 5 != 0).alias("enabled"), F.when(i % 7 != 0, F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) - (i % 25) * 60).cast("timestamp_ntz")).alias("last"))
    h = T.health(F.col("last"), F.col("enabled"), F.date_trunc("second", F.col("ts")).cast("timestamp_ntz"))
    return e.select("id", h.alias("h"), T.watch_late(F.col("last"), F.col("ts")).alias("watch_late")).select("id", "h.*", "watch_late")


def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    """Rows per kind and attempts, with each ladder's wait in seconds."""
    k = F.get_json_object("props", "$.k").cast("long") % 5
    attempts = F.when(k != 4, k)
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("kind"), attempts.alias("attempts")).agg(F.count("*").alias("n"))
    a = F.col("attempts")
    return n.select("*", T.wait_seconds(a, T.SCORING_WAITS).alias("scoring"), T.wait_seconds(a, T.RESEARCH_WAITS).alias("research"), T.job_wait_seconds(F.coalesce(a, F.lit(0))).alias("job"), F.lit(T.CASE_WAIT).alias("case_wait"))


def market_formats(spark: SparkSession, d: str) -> DataFrame:
    i, symbol = F.col("event_id"), pick(SYMBOLS, F.col("event_id"))
    value, change = F.col("value") * 1000, F.floor(F.col("value") - 50) / 4
    return table(spark, d, "events").select(i.alias("id"), T.market_value(symbol, F.round(value, 1)).alias("value"), T.market_change(symbol, change).alias("change"))
