"""Answers of paid models and judges, asked once and kept.

An answer is stored under its task, who was asked and the hash of what was asked.
New ones are written and committed before anything reads them, so all later plans
join a table and none of them calls a model. Requests that failed are stored for
their run, but asked again by the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import storage

#: A model's answer: text or error, and the tokens that were billed.
ANSWER = "struct<text: string, error: string, input_tokens: int, output_tokens: int>"
Model = Callable[[Column], Column]
KEYS = ["task_id", "prompt_sha256"]
SCHEMA = f"task_id string, prompt_sha256 string, asker string, answer {ANSWER}"


def as_answer(df: DataFrame, column: str) -> DataFrame:
    """`column` as ANSWER, whatever part of it a model gives; a string is its text."""
    kind = df.schema[column].dataType
    known = {"text": F.col(column)} if kind.typeName() == "string" else {c: F.col(f"{column}.{c}") for c in kind.names}
    fields = [part.split(": ") for part in ANSWER[len("struct<") : -1].split(", ")]
    return df.withColumn(column, F.struct(*[known.get(name, F.lit(None)).cast(own).alias(name) for name, own in fields]))


class AnswerStore:
    """Stored answers below a path."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or storage.new_path(spark, "answers")

    def table(self) -> DataFrame:
        """All committed answers (task_id, prompt_sha256, asker, answer), failed ones too."""
        return storage.committed(self.spark, self.path, "answers", SCHEMA)

    def ask(self, rows: DataFrame, asker: str, prompt: Column, model: Model, name: str = "answer") -> DataFrame:
        """`rows` (task_id, ...) with the answer of `asker` to each prompt, asked only where none is stored.

        Rows of one task and prompt share one answer.
        """
        keyed = rows.withColumns({"prompt_sha256": F.sha2(F.coalesce(prompt, F.lit("")), 256), "_task": F.col("task_id"), "_prompt": prompt})
        known = self.table().filter((F.col("asker") == asker) & F.col("answer.error").isNull()).select(*KEYS, "answer")
        own = F.col("task_id").cast("string").alias("task_id")
        missing = keyed.withColumn("task_id", own).join(known.select(*KEYS), KEYS, "left_anti").dropDuplicates(KEYS)
        # The prompt is asked for with the task's own id, as models may look at other columns.
        asked = missing.withColumn("task_id", F.col("_task")).withColumn("_answer", model(F.col("_prompt")))
        answered = as_answer(asked, "_answer").select(own, "prompt_sha256", F.lit(asker).alias("asker"), F.col("_answer").alias("answer"))
        run = storage.Run(self.spark, self.path, uuid.uuid4().hex)
        run.write("answers", answered)
        run.commit()
        found = known.unionByName(run.read("answers").select(*KEYS, "answer")).groupBy(*KEYS).agg(F.min("answer").alias(name))
        found = found.withColumnRenamed("task_id", "_id").withColumnRenamed("prompt_sha256", "_hash")
        same = (F.col("task_id").cast("string") == F.col("_id")) & (F.col("prompt_sha256") == F.col("_hash"))
        return keyed.drop(name).join(found, same, "left").drop("_id", "_hash", "_task", "_prompt", "prompt_sha256")
