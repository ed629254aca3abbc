"""Enrichment of tasks as they arrive, as a stream over files.

A task whose id has a note or a reject is not asked again: the file source keeps
what it has read in the checkpoint, and each batch leaves out the ids that the
sinks hold, so a batch that runs again after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillspark.operators.answers import AnswerStore, Model
from quillspark.operators.enrichment import append, enrich, guard, pending
from quillspark.storage import Run, committed


def enrich_stream(spark: SparkSession, tasks_path: str, schema: str, model: Model, path: str, checkpoint: str, most_rejects: float = 0.05, least_tasks: int = 20) -> StreamingQuery:
    """Start a query that enriches all JSON tasks there are and ends.

    Each batch is a run under its own number, so one that was committed before a
    failure is left out when it comes again. The query fails once more than the
    share `most_rejects` of the tasks that were asked so far is rejected,
    `least_tasks` of them at least; what was stored stays.
    """
    store = AnswerStore(spark, f"{path}/answers")

    def batch(rows: DataFrame, number: int) -> None:
        run = Run(spark, path, f"batch-{number}")
        if run.done:
            return
        ids = lambda table: committed(spark, path, table, "task_id string")
        append(enrich(pending(rows.dropDuplicates(["task_id"]), ids("notes"), ids("rejects")), model, store), run)
        asked, rejected = committed(spark, path, "counts", "asked long, rejected long").agg(F.sum("asked"), F.sum("rejected")).first()
        if asked >= least_tasks:
            guard(rejected, asked, most_rejects)

    rows = spark.readStream.schema(schema).json(tasks_path)
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transcript_sessions(segments: DataFrame, gap: str = "8 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of segments (document, ts, text) that a gap ends, with their words, by event time."""
    own = segments.withWatermark("ts", late)
    return own.groupBy("document", F.session_window("ts", gap)).agg(F.count("*").alias("segments"), F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("words"))
