"""Access counters and the unread queue as Structured Streaming, each equal to its batch operator over the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmesh.operators.store import access_counts

COUNTERS = "resource string, tool string, access_count long, first_access timestamp, last_access timestamp"
CHANGES = "conv string, id long, sender string, state string, change long"
_STATE = "sender string, sent boolean, confirmed boolean, change long"


def unique_events(events: DataFrame, key: str = "event_id", time: str = "seen", late: str = "10 minutes") -> DataFrame:
    """A stream's events, each ``key`` once: repeats that come within ``late`` are left out, and state older than that goes."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counter_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: the counters of each batch of events (resource, tool, seen) go to a folder of its own.

    A batch that is run again after a failure overwrites its own folder, so that its events count once.
    """

    def write(batch: DataFrame, number: int) -> None:
        counts = access_counts(batch)
        counts.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in COUNTERS.split(", "))).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def stored_counters(spark: SparkSession, folder: str) -> DataFrame:
    """(resource, tool, access_count, first_access, last_access) over all batches that :func:`counter_writer` wrote."""
    stored = spark.read.schema(COUNTERS + ", batch long").parquet(folder)
    return stored.groupBy("resource", "tool").agg(F.sum("access_count").alias("access_count"), F.min("first_access").alias("first_access"), F.max("last_access").alias("last_access"))


def unread_changes(messages: DataFrame, confirmed: DataFrame, agent: str, late: str = "1 hour", keep_ms: int = 3_600_000) -> DataFrame:
    """(conv, id, sender, state, change): each message of others turns ``unread`` once and ``read`` once; output mode update.

    ``messages`` (conv, id, sender, at) and ``confirmed`` (conv, id, at) are streams, in any order and with repeats: a
    confirmation may come before its message, and is then the only change. The row of the greatest ``change`` is a
    message's state. State is held for each open message; that of a confirmed one goes ``keep_ms`` after the watermark
    has passed its last row, as does a confirmation without a message. Confirmations with a null key meet nothing.
    """
    known = ["conv", "id", "sender", "at", "sent"]
    sent = messages.where(F.col("sender") != agent).withColumn("sent", F.lit(True)).select(*known).withWatermark("at", late)
    done = confirmed.where("conv IS NOT NULL AND id IS NOT NULL").withColumn("sender", F.lit(None).cast("string")).withColumn("sent", F.lit(False))
    rows = sent.unionByName(done.select(*known).withWatermark("at", late))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sender, has_message, has_confirmation, change = state.get if state.exists else (None, False, False, 0)
        was = (has_message, has_confirmation)
        last = 0
        for frame in frames:
            own = frame[frame["sent"]]
            if len(own):
                sender, has_message = (sender if has_message else min(own["sender"])), True
            has_confirmation = has_confirmation or len(own) < len(frame)
            times = frame["at"].dropna()
            last = max(last, int(times.max().timestamp() * 1000)) if len(times) else last
        new = has_message and (not was[0] or (has_confirmation and not was[1]))
        change += new
        state.update((sender, has_message, has_confirmation, change))
        if has_confirmation:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep_ms)
        if new:
            yield pd.DataFrame({"conv": [key[0]], "id": [key[1]], "sender": [sender], "state": ["read" if has_confirmation else "unread"], "change": [change]})

    return rows.groupBy("conv", "id").applyInPandasWithState(step, CHANGES, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def activity_stream(events: DataFrame, time: str, late: str = "10 minutes", window: str = "12 hours") -> DataFrame:
    """Events per tool and window; state is bounded by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "tool").agg(F.count(F.lit(1)).alias("n"))
