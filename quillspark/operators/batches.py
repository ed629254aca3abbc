"""Batches of requests to a service: what is in flight, resuming, and putting results back to their tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import request_key


def requests(tasks: DataFrame) -> DataFrame:
    """request_key and prompt of tasks, as a service takes them."""
    return tasks.select(request_key(F.col("task_id")).alias("request_key"), "prompt")


def remap(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Results (request_key, kind, text, input_tokens, output_tokens) as answers of their tasks.

    A result of another kind than `succeeded` is an error of its task.
    """
    good = F.col("kind") == "succeeded"
    answer = F.struct(
        F.when(good, F.col("text")).alias("text"), F.when(~good, F.concat(F.lit("batch result: "), "kind")).alias("error"),
        F.when(good, F.col("input_tokens")).alias("input_tokens"), F.when(good, F.col("output_tokens")).alias("output_tokens"),
    )
    keyed = tasks.withColumn("request_key", request_key(F.col("task_id")))
    return keyed.join(results.select("request_key", answer.alias("answer")), "request_key").drop("request_key")


def same_tasks(a: DataFrame, b: DataFrame) -> bool:
    """Both hold the same ids, however often."""
    ids = lambda df: df.select("task_id").distinct()
    return ids(a).join(ids(b), "task_id", "left_anti").isEmpty() and ids(b).join(ids(a), "task_id", "left_anti").isEmpty()


def in_flight(spark: SparkSession, path: str) -> DataFrame | None:
    """The batch that was submitted and not yet collected: batch_id, task_id."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(path) if there else None


def run_batch(tasks: DataFrame, submit: Callable[[DataFrame], str], collect: Callable[[str], DataFrame], path: str) -> DataFrame:
    """Answers of tasks by one batch; one that is in flight for the same ids is collected, not submitted again.

    The state below `path` is removed by `finish` once the answers are stored.
    """
    spark = tasks.sparkSession
    state = in_flight(spark, path)
    if state is not None and same_tasks(state, tasks):
        batch_id = state.first()["batch_id"]
    else:
        batch_id = submit(requests(tasks))
        tasks.select(F.lit(batch_id).alias("batch_id"), "task_id").write.mode("overwrite").parquet(path)
    return remap(collect(batch_id), tasks)


def finish(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
