"""Life cycles of records on a stream: guarded steps, time-outs and replay in the order of event time.

Changes wait in the state of their key until the watermark has passed them, and are then taken in their order, so
the files or the batches that they came in make no difference.  A timer wakes the key for the next change or time-out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

ACCEPTED, REJECTED, TIMEOUT = "accepted", "rejected", "timeout"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(StatefulProcessor):
    """One key's record.  Times are microseconds; timers are milliseconds."""

    def __init__(self, allowed: Sequence[tuple[str, str]], first: Sequence[str] | None, final: Sequence[str], limit: timedelta):
        self.allowed, self.first, self.final = set(allowed), None if first is None else set(first), set(final) | {TIMEOUT}
        self.limit = limit // timedelta(microseconds=1)

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, since long")
        self.waiting = handle.getListState("waiting", "at long, id long, state string")

    def close(self) -> None:
        pass

    def may(self, before: str | None, state: str) -> bool:
        return (self.first is None or state in self.first) if before is None else (before, state) in self.allowed

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            new += zip(part["at"].tolist(), part["id"].tolist(), part["state"].tolist(), strict=True)
        if new:
            self.waiting.appendList(new)
            self.wake(min(k[0] for k in new) // 1000)
        return iter(())

    def wake(self, at_ms: int) -> None:
        """One timer, the earliest: it stands for all that waits, so none of that is read for a later change."""
        there = list(self.handle.listTimers())
        if not there or at_ms < min(there):
            for t in there:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        known = sorted(tuple(k) for k in self.waiting.get())
        ready, rest = [k for k in known if k[0] // 1000 <= until], [k for k in known if k[0] // 1000 > until]
        state, since = self.now.get() or (None, None)
        out = []

        def overdue(at_ms: int) -> bool:
            return state is not None and state not in self.final and (since + self.limit) // 1000 <= at_ms

        for at, i, wanted in ready:
            if overdue(at // 1000):
                out.append((None, since + self.limit, state, TIMEOUT, TIMEOUT))
                state, since = TIMEOUT, since + self.limit
            ok = self.may(state, wanted)
            out.append((i, at, state, wanted, ACCEPTED if ok else REJECTED))
            if ok:
                state, since = wanted, at
        if overdue(until):
            out.append((None, since + self.limit, state, TIMEOUT, TIMEOUT))
            state, since = TIMEOUT, since + self.limit
        if state is not None:
            self.now.update((state, since))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        times = [k[0] for k in rest]
        if state is not None and state not in self.final:
            times.append(since + self.limit)
        # the timer that woke the key goes now
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        if times:
            self.handle.registerTimer(min(times) // 1000)
        if out:
            frame = pd.DataFrame(out, columns=["id", "at", "before", "state", "outcome"])
            frame.insert(0, "key", key[0])
            frame["id"] = frame["id"].astype("Int64")
            frame["at"] = pd.to_datetime(frame["at"], unit="us")
            yield frame


def lifecycles(changes: DataFrame, key: str, ts: str, tie: str, state: str, allowed: Sequence[tuple[str, str]], limit: timedelta, first: Sequence[str] | None = None, final: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """key, id, at, before, state, outcome of every change that the watermark has passed, on a stream.

    A change is accepted if the step from the record's state to it is ``allowed`` (a first one: if it is in ``first``); a rejected
    one leaves the state as it is.  A record that stays in a state, but a ``final`` one, for ``limit`` gets a row with
    outcome ``timeout`` and no id, and is in the state ``timeout`` then.  Changes of one time come by ``tie``, a whole number.
    Rows without a key, time or state are left out.  Needs the RocksDB state store (see :func:`rocks`).
    """
    rows = changes.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(state).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("id"), F.col(state).alias("state"))
    kind = changes.schema[key].dataType.simpleString()
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(
        statefulProcessor=Machine(allowed, first, final, limit), outputStructType=f"key {kind}, id long, at timestamp, before string, state string, outcome string", outputMode="Append", timeMode="EventTime"
    )


@contextmanager
def rocks(spark: SparkSession):
    """The state store that timers need, for the streams that start inside."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)


def replayed(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What the life cycles give, appended to a folder, everything there is and then stop; the checkpoint goes on from there."""
    with rocks(changes.sparkSession):
        return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
