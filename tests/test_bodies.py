"""Bodies read as a table and as a stream that stops and goes on; bad ones are rows with their reason."""

import pytest
from pyspark.sql import functions as F

from pressloom.sources import bodies


def put(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_table(spark, tmp_path):
    put(tmp_path, "name=E24 %2F a/x.txt", "å\nb\n".encode())
    put(tmp_path, "name=b/y.txt", b"\xff\xfe")
    put(tmp_path, "name=b/z.txt", b"")
    put(tmp_path, "name=c/big.txt", b"x" * (bodies.LARGEST + 1))
    put(tmp_path, "name=c/_SUCCESS", b"")
    got = {(r["keys"]["name"], r.body, r.error) for r in bodies.read(spark, str(tmp_path)).collect()}
    assert got == {("E24 / a", "å\nb", None), ("b", None, "not UTF-8"), ("b", None, "empty"), ("c", None, "too large")}
    assert bodies.read(spark, str(tmp_path / "none")).count() == 0


def test_written_bodies_come_back(spark, tmp_path):
    rows = [(f"n – {i % 3}", i // 3, f"body\n{i}") for i in range(12)]
    bodies.write(spark.createDataFrame(rows, "name string, day int, body string"), str(tmp_path), "name", "day")
    got = bodies.read(spark, str(tmp_path)).select("keys.name", F.col("keys.day").cast("int"), "body").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_stream_goes_on(spark, tmp_path):
    def take(fail=False):
        rows = bodies.read_stream(spark, str(tmp_path / "in")).select("body", F.raise_error(F.lit("down")).alias("x") if fail else F.lit("").alias("x"))
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start().processAllAvailable()

    def run(fail=False):
        try:
            take(fail)
        finally:
            for q in spark.streams.active:
                q.stop()

    put(tmp_path / "in", "a.txt", b"1")
    put(tmp_path / "in", "b.txt", b"2")
    run()
    put(tmp_path / "in", "0.txt", b"3")
    with pytest.raises(Exception, match="down"):
        run(fail=True)
    put(tmp_path / "in", "c.txt", b"4")
    run()
    assert sorted(r.body for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3", "4"]
