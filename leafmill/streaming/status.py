"""States of documents from their jobs' events, as a running stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.catalog import display_status

#: Kept of a document: the greatest (time, seq) of events that made it ready, that made it fail, and of all, with that one's state.
_STATE = "ready_at long, ready_seq long, failed_at long, failed_seq long, last_at long, last_seq long, last string"
_NEVER = (-(1 << 63), -(1 << 63))


def _status(ready: tuple, failed: tuple, last: str) -> str:
    return "ready" if last in ("queued", "processing") and ready != _NEVER and ready > failed else last


def synced_status_stream(events: DataFrame, key: str, status: str, time: str, seq: str, delay: str = "1 hour", idle_seconds: int = 7 * 86_400) -> DataFrame:
    """Catalog.synced_status of a stream: a row (key, status) whenever a document's state changes. To be run in update mode.

    time: event time, seq: a number that tells events of one time apart. Events may come late, within delay, repeated and in any turn: only
    the greatest places are kept, so the last row of each document is the one that synced_status gives over all events. A document without
    events for idle_seconds of event time is forgotten; an event later than that begins anew. Null keys, times and seqs are left out, as are jobs'
    states that change nothing.
    """
    own = events.select(F.col(key).alias("key"), F.col(time).alias("time"), F.col(seq).cast("long").alias("seq"), display_status(F.col(status)).alias("state"))
    own = own.withWatermark("time", delay).where("key IS NOT NULL AND time IS NOT NULL AND seq IS NOT NULL AND state IS NOT NULL")
    kind = dict(own.dtypes)["key"]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ready, failed, last, now = _NEVER, _NEVER, _NEVER, None
        if state.exists:
            x = state.get
            ready, failed, last, now = (x[0], x[1]), (x[2], x[3]), (x[4], x[5]), x[6]
        before = now and _status(ready, failed, now)
        for frame in frames:
            for at, n, s in zip(frame["time"].astype("datetime64[us]").astype("int64"), frame["seq"], frame["state"], strict=True):
                place = (int(at), int(n))
                if s == "ready":
                    ready = max(ready, place)
                elif s == "failed":
                    failed = max(failed, place)
                if place > last or place == last and s > now:
                    last, now = place, s
        state.update((*ready, *failed, *last, now))
        state.setTimeoutTimestamp(max(last[0] // 1000, state.getCurrentWatermarkMs()) + idle_seconds * 1000)
        after = _status(ready, failed, now)
        if after != before:
            yield pd.DataFrame({"key": [k[0]], "status": [after]})

    out = own.groupBy("key").applyInPandasWithState(run, f"key {kind}, status string", _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("key").alias(key), F.col("status").alias(status))
