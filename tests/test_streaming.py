import datetime as dt

import pytest

from pressloom.streaming import live
from pressloom.streaming.live import keep_live


def test_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * i), float(i % 5)) for i in range(40)]
    schema = "id long, ts timestamp, priority double"
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = keep_live(spark, stream, str(tmp_path / "view"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = max(int(p.name[2:]) for p in (tmp_path / "view").iterdir())
    got = {r.id for r in spark.read.parquet(str(tmp_path / f"view/v={last}")).collect()}
    assert got == set(range(28, 40))


def test_accepted_items(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 5, 1, h, m)
    rows = [(1, at(10), at(10)), (1, at(10), at(10)), (2, None, at(10)), (3, at(11), at(10)), (4, at(10, 10), at(10)), (5, dt.datetime(2024, 4, 30, 12), at(10))]
    spark.createDataFrame(rows, "id long, published timestamp, seen timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, published timestamp, seen timestamp").parquet(f"{tmp_path}/in")
    live.accepted(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 4]


def test_revisions_and_stages(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "flash", "x"), (1, 2, "enriched", "y"), (2, 1, "flash", "z")], "event int, revision int, stage string, body string")
    assert sorted((r.event, r.stage, r.body) for r in live.current(log).collect()) == [(1, "enriched", "y"), (2, "flash", "z")]
    ran = []

    def broken(rows):
        raise ValueError

    stages = [("one", lambda rows: ran.append(1) or spark.range(3)), ("two", lambda rows: rows.where("id > 0"))]
    with pytest.raises(ValueError):
        live.run_stages(spark, f"{tmp_path}/run", [stages[0], ("two", broken)])
    assert live.run_stages(spark, f"{tmp_path}/run", stages) == ["two"] and ran == [1] and spark.read.parquet(f"{tmp_path}/run/two").count() == 2
