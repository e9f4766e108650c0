"""Keyed status over a stream that stops and starts again, against the batch of the whole log."""

import datetime as dt

from brinewood.streaming import live

NAMES = {"key": "user", "at": "ts", "status": "kind"}


def at(minute):
    return dt.datetime(2025, 1, 1, 12) + dt.timedelta(minutes=minute)


def test_each_change_once_over_a_restart(spark, tmp_path):
    kind = "user long, ts timestamp, kind string, extra int"
    parts = [
        [(1, at(0), "a", 1), (1, at(2), "a", 1), (1, at(1), "b", 1), (2, at(0), "a", 1), (None, at(1), "a", 1), (3, None, "a", 1)],
        [(1, at(2), "a", 1), (1, at(3), "c", 1), (2, at(5), None, 1), (2, at(1), "a", 1)],
        [(1, at(1), "z", 1), (2, at(6), "b", 1), (4, at(6), "x", 1), (4, at(6), "w", 1)],
    ]
    schema = spark.createDataFrame([], kind).schema
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/log", mode="append")
        # every run is a query of its own, started from the checkpoint of the last
        stream = live.live_changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), **NAMES)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        assert i or spark.read.parquet(f"{tmp_path}/out").count() == 4
    found = spark.read.parquet(f"{tmp_path}/out")
    got = sorted(tuple(r) for r in found.select("key", "at", "status", "before", "n").collect())
    assert got == sorted(tuple(r) for r in live.changes(spark.createDataFrame(sum([parts[0], parts[1], parts[2][1:]], []), kind), **NAMES).select("key", "at", "status", "before", "n").collect())
    assert [r.key for r in live.snapshot(found, 2).collect()] == ["2", "4"]


def test_silent_keys_stall_once(spark, tmp_path):
    kind = "user long, ts timestamp, kind string"
    schema = spark.createDataFrame([], kind).schema
    for rows in ([(1, at(0), "a"), (2, at(0), "b")], [(2, at(90), "c")], [(2, at(200), "c")], [(2, at(300), "d")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/log", mode="append")
        stream = live.live_changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), **NAMES, late="1 minute", stalled_after_ms=30 * 60_000)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").where("stalled").collect()
    assert [(r.key, r.at, r.status) for r in rows if r.key == "1"] == [("1", at(0), "a")]
