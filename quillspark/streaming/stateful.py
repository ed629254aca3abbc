"""Streams with keyed state and timers: transcripts merged as segments arrive, requests matched with their results.

Both take rows late, twice and out of order, and give what the batch operators
give for the same rows: a transcript's segments are merged in the order of their
numbers, and a request is answered by its first result before its deadline, or
expires. Rows of a null key only move the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions.text import request_key
from quillspark.operators.transcript import joined_to

#: What keyed state with timers needs while a query starts; commits write what has changed.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
MERGED = "document string, index long, text string, start_time_s double, end_time_s double"
ANSWERED = "request_key string, kind string, text string, error string"


@contextmanager
def state_store(spark: SparkSession):
    """Start stateful queries within this; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for key, value in STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


class TranscriptMerger(StatefulProcessor):
    """Merges a document's segments in order; what waits for a lost one is merged when the document has been idle."""

    def __init__(self, limits: tuple[int, float, float], idle_ms: int) -> None:
        self.limits, self.idle_ms = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "next long, index long, text string, start double, end double, due long")
        self.waiting = handle.getMapState("waiting", "seq long", "text string, start double, end double")
        self.done = handle.getValueState("done", "at long")

    def merged(self, key: tuple, held: list, segment: tuple) -> Iterator[Row]:
        """`held` (next, index, text, start, end) with one more segment; what that closes."""
        text = (segment[0] or "").strip()
        if not text:
            return
        both = joined_to(held[2:5], text, segment[1], segment[2], *self.limits) if held[2] is not None else None
        if both is None and held[2] is not None:
            yield self.row(key, held)
            held[1] += 1
        held[2:5] = both or [text, segment[1], segment[2]]

    @staticmethod
    def row(key: tuple, held: list) -> Row:
        return Row(document=key[0], index=held[1], text=held[2], start_time_s=held[3], end_time_s=held[4])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None or self.done.exists():
            return
        *held, due = self.open.get() if self.open.exists() else (0, 0, None, None, None, None)
        latest = None
        for row in rows:
            latest = max(latest or row.at_ms, row.at_ms)
            if row.seq >= held[0] and not self.waiting.containsKey((row.seq,)):
                self.waiting.updateValue((row.seq,), (row.text, row.start, row.end))
        while self.waiting.containsKey((held[0],)):
            yield from self.merged(key, held, self.waiting.getValue((held[0],)))
            self.waiting.removeKey((held[0],))
            held[0] += 1
        new = max(due or 0, latest + self.idle_ms)
        if new != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(new)
        self.open.update((*held, new))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *held, due = self.open.get()
        for seq in sorted(k[0] for k in self.waiting.keys()):
            yield from self.merged(key, held, self.waiting.getValue((seq,)))
        if held[2] is not None:
            yield self.row(key, held)
        self.open.clear()
        self.waiting.clear()
        self.done.update((due,))

    def close(self) -> None:
        pass


def merge_stream(segments: DataFrame, most_words: int = 100, most_seconds: float = 60.0, most_gap: float = 8.0, late: str = "10 minutes", idle_seconds: int = 3600) -> DataFrame:
    """Merged segments (document, index, text, times) of a stream (document, seq from 0, text, start, end, at); a document ends when no segment has come for `idle_seconds`."""
    own = segments.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return own.groupBy("document").transformWithState(TranscriptMerger((most_words, most_seconds, most_gap), idle_seconds * 1000), MERGED, "Append", "EventTime")


class RequestTracker(StatefulProcessor):
    """One answer for each request that was submitted: its result, or that it expired."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")
        self.early = handle.getValueState("early", "at long, kind string, text string")
        self.done = handle.getValueState("done", "at long")

    def answered(self, key: tuple, due: int, kind: str, text: str | None) -> Row:
        self.done.update((due,))
        self.due.clear()
        self.early.clear()
        good = kind == "succeeded"
        return Row(request_key=key[0], kind=kind, text=text if good else None, error=None if good else f"batch result: {kind}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None or self.done.exists():
            return
        due = self.due.get()[0] if self.due.exists() else None
        early = self.early.get() if self.early.exists() else None
        for row in rows:  # a request has a few events, however often they come
            if row.kind == "submitted":
                due = min(due or row.at_ms + self.timeout_ms, row.at_ms + self.timeout_ms)
            elif early is None or row.at_ms < early[0]:
                early = (row.at_ms, row.kind, row.text)
        if due is None:
            if early is not None:
                self.early.update(early)
            return
        if early is not None and early[0] <= due:
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            yield self.answered(key, due, early[1], early[2])
        elif not self.due.exists():
            self.due.update((due,))
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.due.exists():
            yield self.answered(key, self.due.get()[0], "expired", None)

    def close(self) -> None:
        pass


def track_requests(events: DataFrame, timeout_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Answers (request_key, kind, text, error) of a stream of events (request_key, kind, text, at): `submitted`, or a result's kind."""
    own = events.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return own.groupBy("request_key").transformWithState(RequestTracker(timeout_seconds * 1000), ANSWERED, "Append", "EventTime")


def submissions(tasks: DataFrame, at: Column) -> DataFrame:
    """Events that say that the requests of tasks (task_id) were submitted."""
    return tasks.select(request_key(F.col("task_id")).alias("request_key"), F.lit("submitted").alias("kind"), F.lit(None).cast("string").alias("text"), at.alias("at"))
