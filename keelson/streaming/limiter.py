"""A rolling rate as a stream: how many events of a key lie in the window before each, counted when the watermark has passed it.

State holds, by key, the events that aren't final yet and the times that a later window still reaches; a timer at the least pending time makes
them final. Events behind the watermark are dropped, as everywhere in event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that such operators need, as a setting of the session.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_COUNT = Row("key", "id", "recent")


def _timer(at: int) -> int:
    """The first millisecond after a time in microseconds: later than a watermark that hasn't passed it, as timers have to be."""
    return at // 1000 + 1


class _Rolling(StatefulProcessor):
    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Rows are held a batch an element: each call to the state is a message to the JVM."""
        self.handle = handle
        self.pending = handle.getListState("pending", "at array<long>, id array<long>")
        self.past = handle.getValueState("past", "at array<long>")
        self.least = handle.getValueState("least", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        ids, times = map(list, zip(*((id_, at) for _, id_, _, at in rows), strict=True))
        found = self.least.get()
        held, least = (found[0] if found else None), min(times)
        self.pending.appendValue((times, ids))
        if held is None or least < held:
            if held is not None:
                self.handle.deleteTimer(_timer(held))
            self._wait(least)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        """Gives what the watermark has passed, keeps the rest, and forgets times that no later window reaches."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(r for times, ids in self.pending.get() for r in zip(times, ids, strict=True))
        final = [r for r in rows if r[0] <= mark]
        rest = rows[len(final) :]
        past = self.past.get()
        times = sorted([*(past[0] if past else []), *(at for at, _ in final)])
        first = last = 0
        for at, id_ in final:
            while times[first] < at - self.width:
                first += 1
            while last < len(times) and times[last] <= at:
                last += 1
            yield _COUNT(key[0], id_, last - first)
        reached = [at for at in times if at >= mark - self.width]
        if reached:
            self.past.update((reached,))
        elif past:
            self.past.clear()
        if rest:
            self.pending.put([([at for at, _ in rest], [id_ for _, id_ in rest])])
            self._wait(rest[0][0])
        else:
            self.pending.clear()
            self.least.clear()

    def _wait(self, at: int) -> None:
        self.least.update((at,))
        self.handle.registerTimer(_timer(at))

    def close(self) -> None:
        pass


def rolling_counts(stream: DataFrame, key: str, id_: str, time: str, seconds: float, late: str) -> DataFrame:
    """stream: key, id (long), time. key, id and `recent`: the key's events from so many seconds before the event to the event itself. The session has to use PROVIDER."""
    kind = dict(stream.dtypes)[key]
    marked = stream.withWatermark(time, late).select(F.col(key).alias("key"), F.col(id_).cast("long").alias("id"), F.col(time), F.unix_micros(F.col(time)).alias("at"))
    found = marked.groupBy("key").transformWithState(_Rolling(round(seconds * 1_000_000)), f"key {kind}, id long, recent long", "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.col("id").alias(id_), "recent")
