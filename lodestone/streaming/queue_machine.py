"""A work queue as a state machine over its event log, in batch and as a stream with timers.

Items go pending, triggered, embedded; a failure of a triggered item makes it
pending again, until it has failed ``MOST_FAILURES`` times; a triggered item
that hears nothing for ``timeout`` seconds is pending again.  Other events of a
state change nothing.

An event is a map on a handful of states, and maps compose.  So the batch form
folds each item's events in slices of time and then folds the slices; an item
with most of the log is many groups.  The stream keeps one small state an item,
drops replayed events within the watermark, and sets a timer for each triggered
item; a timer that is late is made up for when the item's next event comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST_FAILURES = 3
#: All states: a name and how often the item has failed.
STATES = [("none", 0)] + [(name, n) for n in range(MOST_FAILURES) for name in ("pending", "triggered")] + [("embedded", n) for n in range(MOST_FAILURES)] + [("failed", MOST_FAILURES)]
EVENTS = ("enqueue", "trigger", "embed", "fail")


def after(state: tuple[str, int], event: str | None) -> tuple[str, int]:
    """The state that an event makes of a state."""
    name, failures = state
    if name == "none" and event == "enqueue":
        return "pending", failures
    if name == "pending" and event == "trigger":
        return "triggered", failures
    if name == "triggered" and event == "embed":
        return "embedded", failures
    if name == "triggered" and event == "fail":
        return ("pending", failures + 1) if failures + 1 < MOST_FAILURES else ("failed", MOST_FAILURES)
    return state


def _map_of(event: str | None) -> list[int]:
    return [STATES.index(after(s, event)) for s in STATES]


def _event_map(event: Column) -> Column:
    same, case = F.array(*(F.lit(i) for i in range(len(STATES)))), None
    for e in EVENTS:
        value = F.array(*(F.lit(i) for i in _map_of(e)))
        case = F.when(event == e, value) if case is None else case.when(event == e, value)
    return case.otherwise(same)


def _compose(maps: Column) -> Column:
    """The map that applies the maps in order."""
    same = F.array(*(F.lit(i) for i in range(len(STATES))))
    return F.aggregate(maps, same, lambda done, m: F.transform(done, lambda i: F.element_at(m, i + 1)))


def final_states(events: DataFrame, item: str, ts: str, seq: str, event: str, slice_seconds: int = 3600) -> DataFrame:
    """item, status, failures and events of every item, its events in order of (ts, seq); no timeouts."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(F.col(item).alias("item"), F.floor(t / (slice_seconds * 1_000_000)).alias("_s"), F.struct(t.alias("t"), F.col(seq).alias("n"), F.col(event).alias("e")).alias("_e"))
    ordered = F.transform(F.array_sort(F.collect_list("_e")), lambda x: _event_map(x.e))
    slices = rows.groupBy("item", "_s").agg(_compose(ordered).alias("m"), F.count("*").alias("events"))
    whole = slices.groupBy("item").agg(_compose(F.transform(F.array_sort(F.collect_list(F.struct("_s", "m"))), lambda x: x.m))[0].alias("at"), F.sum("events").alias("events"))
    name = F.element_at(F.array(*(F.lit(s) for s, _ in STATES)), F.col("at") + 1)
    failures = F.element_at(F.array(*(F.lit(n) for _, n in STATES)), F.col("at") + 1)
    return whole.select("item", name.alias("status"), failures.alias("failures"), "events")


class QueueProcessor(StatefulProcessor):
    """One item's status, failures, number of events and since when it is triggered (milliseconds, or -1)."""

    def __init__(self, timeout: int | None = None) -> None:
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, failures int, events long, since long")

    def _expired(self, since: int, now: int) -> bool:
        return self.timeout is not None and since >= 0 and now > since + 1000 * self.timeout

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        status, failures, events, since = self.state.get() if self.state.exists() else ("none", 0, 0, -1)
        if self.timeout is not None and since >= 0:
            self.handle.deleteTimer(since + 1000 * self.timeout + 1)
        for r in sorted(rows, key=lambda r: (r["ts"], r["seq"])):
            now = int(r["ts"].timestamp() * 1000)
            if self._expired(since, now):
                status, since = "pending", -1
            was = status
            status, failures = after((status, failures), r["event"])
            since = (now if was != "triggered" else since) if status == "triggered" else -1
            events += 1
        if self.timeout is not None and since >= 0:
            self.handle.registerTimer(since + 1000 * self.timeout + 1)
        self.state.update((status, failures, events, since))
        yield Row(item=key[0], status=status, failures=failures, events=events)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        status, failures, events, since = self.state.get()
        if status == "triggered":
            self.state.update(("pending", failures, events, -1))
            yield Row(item=key[0], status="pending", failures=failures, events=events)

    def close(self) -> None:
        pass


OUTPUT = "item string, status string, failures int, events long"


def queue_stream(events: DataFrame, timeout: int | None = None, watermark: str = "1 hour") -> DataFrame:
    """Changes of every item's state from a stream of (item, ts, seq, event); events of one (item, seq) count once.

    The session needs the RocksDB state store.
    """
    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["item", "seq"])
    return once.groupBy("item").transformWithState(QueueProcessor(timeout), OUTPUT, "Update", "EventTime" if timeout is not None else "None")


def metric_events(events: DataFrame, question: str = "question", most_chars: int = 200) -> DataFrame:
    """Metric events as they are kept: the question cut to its first characters."""
    return events.withColumn(question, F.substring(question, 1, most_chars))


def counter_stream(events: DataFrame) -> DataFrame:
    """Lifetime counters of a stream, in complete mode: requests, refusals and the mean latency, by mode."""
    refused = F.count_if(F.col("refused"))
    return events.groupBy("mode").agg(F.count("*").alias("requests"), refused.alias("refusals"), F.round(F.avg("latency"), 6).alias("latency"))
