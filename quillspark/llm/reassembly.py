"""Conversations put together again from turns that arrive in batches, late, twice and out of order.

A stateful query keeps, for each conversation, the turns that wait for an earlier
one. Its event time is the number of a batch, so its watermark is one too: every
arrival of a conversation deletes the conversation's timer and registers it anew
at the last batch with an arrival plus `idle`. A timer that expires closes the
conversation; what stays of it is a tombstone that rejects later turns.

The query is started once for each batch, on one checkpoint. A batch without
rows still moves the watermark by a tick, a row of its own key. Only numbers and
roles go through the state; payloads stay in the written table of arrivals and
are joined to the events afterwards. A conversation is a key of the state: its
waiting turns are entries of a map in the state store and never in memory
together, except their numbers when it closes.

Edge cases: rows without a turn are dropped; null roles and texts are empty, and
a null conversation is one of its own, hashed as if empty; of rows that arrive in
one batch with equal payloads the smallest role counts; a turn that arrives again
counts as an arrival of its conversation, but the first stays; an empty table
gives no events.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.storage import new_path

#: Batches without an arrival that close a conversation.
IDLE = 3
#: Milliseconds of event time that stand for one batch.
STEP = 3_600_000
#: Rows of a conversation that are put into order at once.
CHUNK = 1000
#: Whether the watermark that a start has reached fires timers in the same start; else in the next, which saves every other pass.
NO_DATA = ("spark.sql.streaming.noDataMicroBatches.enabled",)
EVENTS = "event string, conv_id long, turn long, batch long, kept_in long, waiting string, n_missing long, n_breaks long"
#: Settings of the state store while the query runs: commits write what has changed instead of all files, a store leaves its
#: executor's disk with its task, as the next start loads it anew, files take no more room than they fill, and a file of the
#: checkpoint, which ends with the query, is one file without a second one for its checksum.
STORE = {
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def moment(batch: int) -> int:
    """Event time of a batch in milliseconds; the first is above zero."""
    return (batch + 1) * STEP


class Reassembler(StatefulProcessor):
    """Releases a conversation's turns in order and closes it after `idle` batches, or as batch `end`."""

    def __init__(self, idle: int, end: int) -> None:
        self.idle, self.end = idle, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: next: the turn to be released; role: of the one before; last: batch of the last arrival.
        self.open = handle.getValueState("open", "first long, next long, role string, last long, largest long, n_kept long, n_breaks long, n_waiting long")
        self.waiting = handle.getMapState("waiting", "turn long", "batch long, role string")
        self.closed = handle.getValueState("closed", "batch long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        conv_id, tick = key
        if tick:
            return
        state = self.open.get() if self.open.exists() else None
        if state is not None and moment(state[3] + self.idle) <= timerValues.getCurrentWatermarkInMs():
            # The arrivals of a start come before the timers that the batch before has made due.
            self.handle.deleteTimer(moment(state[3] + self.idle))
            yield self.close_conversation(conv_id, state)
            state = None
        if state is None and self.closed.exists():
            for row in rows:
                yield self.event("reject", conv_id, row.turn, row.batch, row.batch)
            return
        due = moment(state[3] + self.idle) if state is not None else None
        while chunk := sorted(islice(rows, CHUNK), key=lambda r: r.turn):
            for row in chunk:
                first, after, role, last, largest, kept, breaks, n = state or (row.first, row.first, None, row.batch, row.turn, 0, 0, 0)
                last = max(last, row.batch)
                held = lambda turn: self.waiting.getValue((turn,)) if n else None  # noqa: E731, B023
                if row.turn >= after and held(row.turn) is None:
                    before = (after > first and role) if row.turn == after else (held(row.turn - 1) or (None, False))[1]
                    behind = (held(row.turn + 1) or (None, False))[1]
                    kept, largest = kept + 1, max(largest, row.turn)
                    breaks += (before == row.role) + (behind == row.role)
                    if row.turn == after:
                        yield self.event("release", conv_id, after, row.batch, row.batch)
                        after, role = after + 1, row.role
                        while found := held(after):
                            yield self.event("release", conv_id, after, row.batch, found[0])
                            self.waiting.removeKey((after,))
                            after, role, n = after + 1, found[1], n - 1
                    else:
                        self.waiting.updateValue((row.turn,), (row.batch, row.role))
                        n += 1
                state = (first, after, role, last, largest, kept, breaks, n)
        if state is None:
            return
        self.open.update(state)
        if due != moment(state[3] + self.idle):
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(moment(state[3] + self.idle))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            yield self.close_conversation(key[0], self.open.get())

    def close_conversation(self, conv_id: int | None, state: tuple) -> Row:
        """The event; a tombstone takes the place of all other state."""
        first, _, _, last, largest, kept, breaks, n = state
        turns = sorted(k[0] for k in self.waiting.keys()) if n else []
        batch = min(last + self.idle, self.end)
        self.open.clear()
        self.waiting.clear()
        self.closed.update((batch,))
        return self.event("close", conv_id, -1, batch, None, ",".join(map(str, turns)), largest - first + 1 - kept, breaks)

    @staticmethod
    def event(event: str, conv_id, turn, batch, kept_in, waiting=None, missing=None, breaks=None) -> Row:
        return Row(event=event, conv_id=conv_id, turn=turn, batch=batch, kept_in=kept_in, waiting=waiting, n_missing=missing, n_breaks=breaks)

    def close(self) -> None:
        pass


def deal(turns: DataFrame, conv_id: Column, turn: Column, role: Column, text: Column, batches: int = 8) -> DataFrame:
    """conv_id, turn, role, text, batch: every turn in the batch its hash decides, and some once more, as `user`, in a later or earlier one."""
    name = F.concat(F.coalesce(conv_id.cast("string"), F.lit("")), F.lit(":"), turn.cast("string"))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    once = F.struct((h % batches).alias("batch"), F.coalesce(role, F.lit("")).alias("role"))
    again = F.struct(((h + 3) % batches).alias("batch"), F.lit("user").alias("role"))
    rows = turns.filter(turn.isNotNull()).select(conv_id.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(text, F.lit("")).alias("text"), F.explode(F.when(h % 7 < 2, F.array(once, again)).otherwise(F.array(once))).alias("a"))
    return rows.select("conv_id", "turn", "a.role", "text", "a.batch")


def arrivals(dealt: DataFrame) -> DataFrame:
    """Of each turn the smallest payload of a batch, with its role and the conversation's smallest turn."""
    payload = F.concat("role", F.lit("|"), "text").alias("payload")
    least = dealt.groupBy("conv_id", "turn", "batch").agg(F.min(F.struct(payload, "role")).alias("m"))
    firsts = dealt.groupBy(F.col("conv_id").alias("conv")).agg(F.min("turn").alias("first"))
    return least.join(firsts, F.col("conv_id").eqNullSafe(F.col("conv"))).select("conv_id", "turn", "batch", "first", "m.role", "m.payload")


def feed(spark: SparkSession, written: DataFrame, batch: int, path: str) -> None:
    """Append a batch of the written arrivals, without payloads, and its tick to the folder that the stream reads."""
    at = F.timestamp_millis(F.lit(moment(batch))).alias("at")
    rows = written.filter(F.col("batch") == batch).select("conv_id", F.lit(False).alias("tick"), "turn", F.col("batch").cast("long"), "first", "role", at)
    tick = spark.range(1).select(F.lit(None).cast("long").alias("conv_id"), F.lit(True).alias("tick"), F.lit(None).cast("long").alias("turn"), F.lit(batch).cast("long").alias("batch"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("string").alias("role"), at)
    rows.unionByName(tick).write.mode("append").parquet(path)


def advance(spark: SparkSession, source: str, schema, checkpoint: str, sink: str, idle: int, end: int) -> None:
    """Start the query on what is new in `source`, and wait for its end."""
    turns = spark.readStream.schema(schema).parquet(source).withWatermark("at", "0 seconds")
    events = turns.groupBy("conv_id", "tick").transformWithState(Reassembler(idle, end), EVENTS, "Append", "EventTime")
    query = events.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def reassemble(dealt: DataFrame, batches: int = 8, idle: int = IDLE) -> DataFrame:
    """event (release, reject, close), conv_id, turn, batch, payload, n_missing, n_breaks of turns (conv_id, turn, role, text, batch).

    A release's and a reject's payload is `role|text`, a close's the numbers of
    the turns that were kept and not released. Batches are numbered from 0;
    conversations that are open at the end close as batch `batches`.
    """
    spark = dealt.sparkSession
    root = new_path(spark, "reassembly")
    arrivals(dealt).write.partitionBy("batch").parquet(f"{root}/arrivals")
    written = spark.read.schema("conv_id long, turn long, first long, role string, payload string, batch long").parquet(f"{root}/arrivals")
    before = {k: spark.conf.get(k, None) for k in (*STORE, *NO_DATA)}
    for setting, value in STORE.items():
        spark.conf.set(setting, value)
    try:
        # The last start has a tick alone, late enough for all timers.
        for batch in (*range(batches), batches + idle):
            spark.conf.set(*NO_DATA, "true" if batch >= batches else "false")
            feed(spark, written, batch, f"{root}/feed")
            advance(spark, f"{root}/feed", "conv_id long, tick boolean, turn long, batch long, first long, role string, at timestamp", f"{root}/checkpoint", f"{root}/events", idle, batches)
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value) if value is not None else spark.conf.unset(setting)
    events = spark.read.schema(EVENTS).parquet(f"{root}/events").alias("e")
    texts = written.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("batch").alias("b"), "payload")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("kept_in") == F.col("b"))
    own = F.coalesce("waiting", "payload").alias("payload")
    return events.join(texts, same, "left").select("event", "conv_id", "turn", "batch", own, "n_missing", "n_breaks")
