import datetime as dt
import random

from pyspark.sql import functions as F
from tesserakit.streaming import events as E

T0 = dt.datetime(2025, 1, 1, 0, 59, 58)


def frame(spark, rows):
    return spark.createDataFrame([(p, k, None if s is None else T0 + dt.timedelta(seconds=s)) for p, k, s in rows], "path string, event_type string, ts timestamp")


def test_sessions_by_hand(spark):
    rng = random.Random(1)
    times = sorted(rng.uniform(0, 20_000) if rng.random() < 0.5 else rng.uniform(0, 600) for _ in range(600))
    got = E.sessions(E.relevant(frame(spark, [("a.py", "change", s) for s in times])).select("path", "event", "ts")).orderBy("ts").collect()
    start, last = None, None
    for r in got:
        if last is None or (r["ts"] - last).total_seconds() > 2.0:
            start = r["ts"]
        last = r["ts"]
        assert r["session_start"] == start


def test_gap_at_the_delay_merges(spark):
    rows = E.sessions(E.relevant(frame(spark, [("a.py", "add", 0), ("b.py", "add", 2), ("a.py", "delete", 4.000001)])))
    assert rows.select("session_start").distinct().count() == 2


def test_last_event_wins(spark):
    rows = E.relevant(frame(spark, [("a.py", "Change", 0), ("a.py", "DELETE ", 1), ("a.py", "change", 1), ("x.zip", "change", 5), (None, "change", 1), ("b.py", None, 1), ("c.py", "change", None), ("d.py", "odd", 1)]))
    assert [(r["path"], r["event"]) for r in E.last_event_wins(rows).collect()] == [("a.py", "delete")]
    assert E.sessions(rows.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    frame(spark, [("a.py", "change", 0), ("a.py", "delete", 1), ("b.py", "change", 9)]).write.parquet(source)
    stream = spark.readStream.schema("path string, event_type string, ts timestamp").parquet(source).select("path", E.kind_of("event_type").alias("event"), "ts")
    E.follow(stream, str(tmp_path / "check"), lambda batch, n: batch.write.mode("append").parquet(str(tmp_path / "out"))).awaitTermination()
    assert sorted((r["path"], r["event"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a.py", "delete"), ("b.py", "change")]
    bursts = E.stream_sessions(spark.readStream.schema("path string, event_type string, ts timestamp").parquet(source).withColumn("event", E.kind_of("event_type")))
    q = bursts.writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert bursts.isStreaming and F.col("x") is not None


def test_folder_events_and_moves(spark):
    listing = lambda rows: spark.createDataFrame(rows, "path string, mtime_ns bigint")
    unchanged = E.folder_events(listing([("a", 10), ("c", None)]), listing([("a", 10), ("c", None)]))
    assert unchanged.count() == 0
    assert {r["path"]: r["event"] for r in E.folder_events(listing([("a", 10), ("b", 10)]), listing([("b", 11), ("d", 5)])).collect()} == {"a": "delete", "b": "change", "d": "change"}
    rows = spark.createDataFrame([("a.py", "moved", T0, "b.py"), ("c.py", "change", T0, None), ("d.py", "Moved ", T0, None)], "path string, event_type string, ts timestamp, dest_path string")
    assert sorted((r["path"], r["event_type"]) for r in E.moved(rows).collect()) == [("a.py", "deleted"), ("b.py", "change"), ("c.py", "change"), ("d.py", "deleted")]
    assert E.folder_events(listing([]), listing([])).count() == 0


def test_late_events_across_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in ([("a.py", "delete", 5), ("b.py", "change", 1)], [("a.py", "change", 3), ("b.py", "delete", 2)], [("c.py", "change", 0), ("b.py", "delete", 2)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema("path string, event_type string, ts timestamp").parquet(source).select("path", E.kind_of("event_type").alias("event"), "ts")
    acted = []
    last = E.LastEvents(spark, str(tmp_path / "last"), lambda batch, n: acted.extend((n, r["path"], r["event"]) for r in batch.collect()))
    E.follow(stream, str(tmp_path / "check"), last).awaitTermination()
    assert sorted((r["path"], r["event"]) for r in last.now().collect()) == [("a.py", "delete"), ("b.py", "delete"), ("c.py", "change")]
    per_path = [e for _, p, e in sorted(acted) if p == "a.py"]
    assert len({n for n, *_ in acted}) >= 2 and per_path[-1] == "delete" and len(acted) == len(set(acted))
