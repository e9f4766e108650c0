"""Live status of records: a keyed state that turns a log of events into changes, and the snapshot that viewers start from."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

CHANGE = "key string, at timestamp, status string, before string, n long, stalled boolean"
STATE = "at timestamp, status string, n long, stalled boolean"


def live_changes(events: DataFrame, *, key: str, at: str, status: str, late: str = "10 minutes", stalled_after_ms: int = 0) -> DataFrame:
    """[STM-01] A stream of events to its changes (key, at, status, before, n, stalled): the n-th change of a key, what it was
    before, and when.

    Each key's state is its newest event. An event that is older than that, or repeats its status, changes nothing, so a
    log that is read twice, out of order within a batch, or with repeated rows gives each change once; the state is kept in
    the checkpoint, so that a restart goes on where the last batch ended. Events later than `late` behind the newest are
    left out by the watermark. With stalled_after_ms, a key without events for so long in event time gives one more row
    with `stalled`, at its last event. Null keys, times and statuses are no events.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(status).alias("status"))
    rows = rows.where("key is not null and at is not null and status is not null").withWatermark("at", late)

    def step(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, now, n, stalled = state.get if state.exists else (None, None, 0, False)
        out = []
        if state.hasTimedOut:
            out.append((own[0], last, now, now, n, True))
            state.update((last, now, n, True))
        else:
            every = pd.concat(list(parts)).sort_values(["at", "status"])
            for when, found in zip(every["at"].dt.to_pydatetime(), every["status"], strict=True):
                if last is not None and when <= last:
                    continue
                last, stalled = when, False
                if found != now:
                    n += 1
                    out.append((own[0], when, found, now, n, False))
                    now = found
            state.update((last, now, n, stalled))
            if stalled_after_ms:
                state.setTimeoutTimestamp(max(int(pd.Timestamp(last).timestamp() * 1000) + stalled_after_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at", "status", "before", "n", "stalled"])

    timeout = GroupStateTimeout.EventTimeTimeout if stalled_after_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(step, StructType.fromDDL(CHANGE), StructType.fromDDL(STATE), "append", timeout)


def changes(events: DataFrame, *, key: str, at: str, status: str) -> DataFrame:
    """The changes of a whole log as a batch: what live_changes gives in the end of a log without late events."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(status).alias("status"))
    # of events at one time the one of the least status counts, as in the stream
    rows = rows.where("key is not null and at is not null and status is not null").groupBy("key", "at").agg(F.min("status").alias("status"))
    order = Window.partitionBy("key").orderBy("at")
    moved = rows.withColumn("before", F.lag("status").over(order)).where("before is null or before <> status")
    return moved.withColumn("n", F.row_number().over(order).cast("long"))


def snapshot(found: DataFrame, most: int = 50) -> DataFrame:
    """[STM-01] What a viewer is sent first: the last change of each key, the newest `most` of them; ties by key."""
    last = found.groupBy("key").agg(F.max_by(F.struct("at", "status", "n"), F.struct("at", "n")).alias("c")).select("key", "c.*")
    return last.orderBy(F.desc("at"), "key").limit(most)
