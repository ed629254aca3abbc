"""Two rounds of a model over tasks: try, check, try once more with the errors, reject.

The model is a function from a prompt column to an answer column (an Arrow UDF
that calls a service, or any expression). Each round's answers are written
before they are read, so a retry of a Spark task doesn't ask again for answers
that were stored, and all that follows sees the same answers.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillspark.operators.answers import AnswerStore, Model
from quillspark.operators.pack import retry_prompt
from quillspark.operators.validation import checked
from quillspark.storage import Run, materialise


class TooManyRejects(RuntimeError):
    """The share of rejected tasks exceeds the limit."""


def pending(tasks: DataFrame, done: DataFrame, rejected: DataFrame) -> DataFrame:
    """Tasks that have neither a note nor a reject."""
    return tasks.join(done.select("task_id"), "task_id", "left_anti").join(rejected.select("task_id"), "task_id", "left_anti")


def attempt(tasks: DataFrame, model: Model, prompt: Column, name: str, store: AnswerStore | None = None, asker: str = "") -> DataFrame:
    """Tasks with answer, note (JSON or null) and errors of one round, written once."""
    asked = (store or AnswerStore(tasks.sparkSession)).ask(tasks, f"teacher:{asker}", prompt, model)
    read = asked.withColumn("_checked", checked(F.col("answer.text")))
    failed = F.when(F.col("answer.error").isNotNull(), F.array(F.concat(F.lit("request failed: "), F.col("answer.error"))))
    made = materialise(read.withColumn("errors", F.coalesce(failed, F.col("_checked.errors"))), name)
    return made.withColumn("note", F.when(F.size("errors") == 0, F.col("_checked.json"))).drop("_checked")


@dataclass
class Rounds:
    """What two rounds gave: notes, rejects, and all attempts."""

    notes: DataFrame
    rejects: DataFrame
    attempts: DataFrame


def enrich(tasks: DataFrame, model: Model, store: AnswerStore | None = None, asker: str = "") -> Rounds:
    """Notes and rejects for tasks (task_id, prompt, ...); answers in `store` aren't asked for again."""
    store = store or AnswerStore(tasks.sparkSession)
    first = attempt(tasks, model, F.col("prompt"), "first-round", store, asker)
    failed = first.filter("note is null").withColumn("prompt", retry_prompt(F.col("prompt"), F.col("errors"))).drop("answer", "errors", "note")
    second = attempt(failed, model, F.col("prompt"), "second-round", store, asker)
    attempts = first.withColumn("retried", F.lit(False)).unionByName(second.withColumn("retried", F.lit(True)))
    notes = attempts.filter("note is not null")
    return Rounds(notes, second.filter("note is null"), attempts)


def summary(attempts: DataFrame, tasks_total: int, already_done: int) -> DataFrame:
    """One row of counters over all attempts; failed requests aren't billed, rejected answers are."""
    ok, retried = F.col("note").isNotNull(), F.col("retried")
    billed = F.col("answer.error").isNull()
    tokens = lambda c: F.coalesce(F.sum(F.when(billed, F.coalesce(F.col(f"answer.{c}"), F.lit(0)))), F.lit(0)).alias(c)
    return attempts.agg(
        F.lit(tasks_total).alias("tasks_total"), F.lit(already_done).alias("already_done"), F.count_if(ok).alias("newly_enriched"),
        F.count_if(retried).alias("retried"), F.count_if(retried & ~ok).alias("rejected"), tokens("input_tokens"), tokens("output_tokens"),
    )


def guard(rejected: int, total: int, most: float = 0.05) -> None:
    """Raise if more than the share `most` of all tasks is rejected."""
    if total and rejected / total > most:
        raise TooManyRejects(f"{rejected} of {total} tasks are rejected")


def append(rounds: Rounds, run: Run) -> tuple[int, int]:
    """Commit notes, rejects and their numbers as one run; how many tasks were asked and rejected, observed as they are written."""
    keep = [c for c in ("task_id", "split", "source_id") if c in rounds.notes.columns]
    noted, rejected = Observation("notes"), Observation("rejects")
    run.write("notes", rounds.notes.select(*keep, F.col("note").alias("study_note"), "answer.input_tokens", "answer.output_tokens", "retried").observe(noted, F.count("*").alias("n")))
    run.write("rejects", rounds.rejects.select(*keep, "errors").observe(rejected, F.count("*").alias("n")))
    bad = rejected.get["n"]
    asked = noted.get["n"] + bad
    run.write("counts", run.spark.range(1).select(F.lit(asked).cast("long").alias("asked"), F.lit(bad).cast("long").alias("rejected")))
    run.commit()
    return asked, bad


def run(tasks: DataFrame, done: DataFrame, rejected: DataFrame, model: Model, path: str, sample: int | None = None, most_rejects: float = 0.05, store: AnswerStore | None = None, asker: str = "", run_id: str | None = None) -> DataFrame:
    """Enrich what is pending, append notes and rejects below `path` as one run, return the summary.

    A run that fails before both are written leaves nothing that counts (see
    `storage.committed`), and its tasks are still pending; with a `store` that
    outlives it their answers aren't paid for again. `sample` takes the first
    tasks by `ord`, if tasks have that column, else by id.
    """
    total, before, old = tasks.count(), done.count(), rejected.count()
    todo = pending(tasks, done, rejected)
    if sample is not None:
        todo = todo.orderBy("ord" if "ord" in tasks.columns else "task_id").limit(sample)
    rounds = enrich(todo, model, store, asker)
    _, bad = append(rounds, Run(tasks.sparkSession, path, run_id or uuid.uuid4().hex))
    guard(old + bad, total, most_rejects)  # beyond the limit no summary is written
    row = summary(rounds.attempts, total, before)
    row.coalesce(1).write.mode("append").json(f"{path}/summary")
    return row
