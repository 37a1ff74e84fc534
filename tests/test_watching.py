"""Rows refused with their reason, and the health of running and stopped streams."""

import datetime as dt

from pyspark.sql import functions as F

from pressloom.streaming import watching

SCHEMA = "id long, ts timestamp, seen timestamp"


def test_rows_are_taken_or_refused(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 5, 1, h, m)
    parts = [
        [(1, at(10), at(10)), (2, at(7), at(10)), (3, None, at(10)), (4, at(10, 16), at(10)), (5, at(10, 15), at(10))],
        [(6, at(8), at(11)), (7, at(8, 15), at(11)), (8, at(8, 14), at(11)), (9, at(11), at(11))],
        [(10, at(8, 59), at(12)), (11, at(9), at(12))],
    ]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/p={n}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/p=*")
        watching.write_sorted_out(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    taken = sorted(r.id for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out/taken/b=*").collect())
    refused = sorted((r.id, r.reason) for r in spark.read.schema(SCHEMA + ", reason string").parquet(f"{tmp_path}/out/refused/b=*").collect())
    assert taken == [1, 2, 5, 7, 9, 11] and refused == [(3, "undated"), (4, "ahead"), (6, "late"), (8, "late"), (10, "late")]


def test_health_of_streams(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/in")
    listener = watching.Progress()
    spark.streams.addListener(listener)
    try:
        start = lambda name, rows: rows.writeStream.queryName(name).format("noop").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        read = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        start("fine", read()).awaitTermination(60)
        broken = start("broken", read().select(F.raise_error(F.lit("no"))))
        try:
            broken.awaitTermination(60)
        except Exception as error:
            assert "no" in str(error)
        for _ in range(100):
            if any(r[-1] for r in listener.rows) and any(r[5] for r in listener.rows):
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    progress = listener.table(spark)
    last = progress.agg(F.max("seen")).first()[0]
    noon = last.replace(hour=12, minute=0, second=0, microsecond=0)
    moved = progress.withColumn("seen", F.when(F.col("seen").isNotNull(), F.lit(noon)))
    found = {r.query: r for r in watching.stream_health(moved, F.lit(noon + dt.timedelta(minutes=4)).cast("timestamp")).collect()}
    assert found["fine"].status == "ok" and found["fine"].rows == 10 and found["fine"].batches >= 1
    assert found["broken"].status == "failed" and "no" in found["broken"].error
    stopped = {r.query: r for r in watching.stream_health(moved, F.lit(noon + dt.timedelta(minutes=21)).cast("timestamp")).collect()}
    assert stopped["fine"].status == "error" and stopped["fine"].delay_minutes == 16
