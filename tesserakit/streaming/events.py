"""File events in batch and as a stream.

In batch, the debounce timer is global: a session is a run of events with gaps of at most the delay. Its lag runs within
buckets of time and only each bucket's last event goes through a window over all, so all events are never sorted in one
task for lack of a key. A bucket is an hour's different times, which one task sorts. As a stream, sessions are Spark's own
and per path: there a burst is over when its own path has been quiet, whatever the other paths do.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.store import VersionedTable
from ..sources import formats, skip

DELAY = 2.0
#: Seconds of a bucket.
BUCKET = 3600


def kind_of(event_type: str | Column) -> Column:
    """change for created, modified and the like, delete for deleted and moved-away; null for anything else."""
    low = F.lower(F.trim(event_type))
    return F.when(low.isin("add", "added", "created", "create", "modified", "modify", "change", "changed"), "change").when(low.isin("deleted", "delete", "removed"), "delete").when(low.isin("moved", "move", "renamed"), "delete")


def folder_events(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, event and ts: what happened to a folder between two listings (path, mtime_ns).

    A file that is new or has another time is a change at its time (a null time: at the present), one that is gone a deletion
    at the present. A move is so a deletion where the file was and a change where it is.
    """
    was = before.dropDuplicates(["path"]).select("path", F.col("mtime_ns").alias("_was"), F.lit(True).alias("_known"))
    both = was.join(now.dropDuplicates(["path"]).select("path", "mtime_ns", F.lit(True).alias("_there")), "path", "full_outer")
    event = F.when(F.col("_there").isNull(), "delete").when(F.col("_known").isNull() | ~F.col("mtime_ns").eqNullSafe(F.col("_was")), "change")
    at = F.when(event == "change", F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000)))
    return both.select("path", event.alias("event"), F.coalesce(at, F.current_timestamp()).alias("ts")).filter("event is not null")


def moved(events: DataFrame) -> DataFrame:
    """Events (path, event_type, ts, dest_path) with each move as a deletion of the path and a change of the destination."""
    move = F.lower(F.trim("event_type")).isin("moved", "move", "renamed")
    there = events.filter(move & F.col("dest_path").isNotNull()).select(F.col("dest_path").alias("path"), F.lit("change").alias("event_type"), "ts")
    return events.select("path", F.when(move, F.lit("deleted")).otherwise(F.col("event_type")).alias("event_type"), "ts").unionByName(there)


def relevant(events: DataFrame) -> DataFrame:
    """Events of files that have a parser and aren't skipped; without path, time or a known type an event is none. Repeated rows count once."""
    kept = events.select("path", kind_of("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts")).dropna().distinct()
    return kept.filter(formats.supported("path") & ~skip.skipped_path("path"))


def last_event_wins(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """path, the latest event and its time; at one time a deletion wins."""
    return events.groupBy(*(by or []), "path").agg(F.max(F.struct("ts", "event")).alias("e")).select(*(by or []), "path", F.col("e.event").alias("event"), F.col("e.ts").alias("ts"))


def sessions(events: DataFrame, delay: float = DELAY) -> DataFrame:
    """``events`` (path, event, ts) with session_start: the first time of the run of events, gaps within ``delay``, that each is in."""
    us = F.unix_micros("ts")
    rows = events.withColumn("_t", us).withColumn("_b", F.floor(us / (BUCKET * 1_000_000)))
    times = rows.select("_b", "_t").distinct()
    last = times.groupBy("_b").agg(F.max("_t").alias("_last"))
    # one row a bucket
    carried = last.withColumn("_carried", F.lag("_last").over(W.orderBy("_b"))).select("_b", "_carried")
    inside = W.partitionBy("_b").orderBy("_t")
    gap = times.withColumn("_own", F.lag("_t").over(inside)).join(carried, "_b").withColumn("_before", F.coalesce("_own", "_carried"))
    opened = gap.withColumn("_open", F.when(F.col("_before").isNull() | (F.col("_t") - F.col("_before") > int(delay * 1e6)), F.col("_t")))
    # the latest opening at or before each time: within the bucket, else the last one of the buckets before
    opens = opened.groupBy("_b").agg(F.max("_open").alias("_o"))
    earlier = opens.withColumn("_earlier", F.last("_o", True).over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).select("_b", "_earlier")
    start = F.coalesce(F.last("_open", True).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)), F.col("_earlier"))
    marked = opened.join(earlier, "_b").withColumn("session_start", F.timestamp_micros(start)).select("_b", "_t", "session_start")
    return rows.join(marked, ["_b", "_t"]).drop("_b", "_t")


def stream_sessions(events: DataFrame, delay: str = "2 seconds", late: str = "1 hour") -> DataFrame:
    """A stream of (path, event, ts): per path the latest event of each burst, out once the burst is over by ``late``."""
    burst = F.session_window("ts", delay)
    done = events.withWatermark("ts", late).groupBy(burst.alias("burst"), "path").agg(F.max(F.struct("ts", "event")).alias("e"), F.count("*").alias("events"))
    return done.select("path", F.col("burst.start").alias("started"), F.col("e.event").alias("event"), F.col("e.ts").alias("ts"), "events")


def follow(events: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None], once: bool = True):  # noqa: ANN201
    """Runs ``act`` on each micro-batch of last events: what is there now, or on and on.

    Within a batch the last event of a path counts; across batches an event that comes late may be older than one acted on
    (see ``LastEvents``). A batch that is run again after a failure has the same number.
    """
    writer = events.writeStream.foreachBatch(lambda batch, n: act(last_event_wins(batch), n)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


class LastEvents:
    """For ``follow``: passes on those last events of a batch that are newer than what a path's last event was, and remembers them.

    The memory is a table by path in a shared folder, divided by path, so a batch rewrites the parts of its paths. ``act``
    runs before a batch is remembered: one that is run again is passed on again, so ``act`` should bear that.
    """

    def __init__(self, spark: SparkSession, folder: str, act: Callable[[DataFrame, int], None]):
        self.table, self.act = VersionedTable(spark, folder, "path string, event string, ts timestamp", "path"), act

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.select("path", "event", "ts").persist()
        try:
            parts = self.table.parts_of(batch.select("path"))
            known = self.table.read(parts)
            was = known.select("path", F.struct("ts", "event").alias("_was"))
            newer = batch.join(was, "path", "left").filter(F.col("_was").isNull() | (F.struct("ts", "event") > F.col("_was"))).drop("_was")
            self.act(newer, number)
            self.table.write(last_event_wins(known.unionByName(batch)).select("path", "event", "ts"), parts=parts)
        finally:
            batch.unpersist()

    def now(self) -> DataFrame:
        """path, event and ts of every path's last event so far."""
        return self.table.read()


class Progress(StreamingQueryListener):
    """Tells ``report`` of a stream's progress, no more often than every ``every`` seconds but for the end."""

    def __init__(self, report: Callable[[dict], None], every: float = 0.25):
        self.report, self.every, self.last = report, every, 0.0

    def onQueryStarted(self, event):  # noqa: ANN001, N802
        self.report({"state": "started", "id": str(event.id)})

    def onQueryProgress(self, event):  # noqa: ANN001, N802
        if (now := time.monotonic()) - self.last >= self.every:
            self.last = now
            self.report({"state": "running", "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event):  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event):  # noqa: ANN001, N802
        self.report({"state": "ended", "error": event.exception})
