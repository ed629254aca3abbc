"""Evaluation of notes: names grounded in the source, rates and means, comparison of models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import groundedness_form, is_grounded, strip
from quillspark.operators.answers import AnswerStore
from quillspark.operators.validation import RUBRIC, checked, verdict
from quillspark.storage import materialise

#: The parts of a note that name things.
CLAIMS = "important_features_or_tools array<struct<name: string, important_parameters: array<struct<parameter: string>>>>, key_concepts array<struct<concept: string>>"


def claimed_names(note_json: Column) -> Column:
    """Names of features, each followed by its parameters, then concepts; none blank."""
    note = F.from_json(note_json, CLAIMS)
    none = F.array().cast("array<string>")
    own = lambda f: F.concat(F.array(f["name"]), F.coalesce(F.transform(f["important_parameters"], lambda p: p["parameter"]), none))
    features = F.coalesce(F.flatten(F.transform(note["important_features_or_tools"], own)), none)
    concepts = F.coalesce(F.transform(note["key_concepts"], lambda c: c["concept"]), none)
    return F.filter(F.transform(F.concat(features, concepts), strip), lambda n: n.isNotNull() & (n != ""))


def with_groundedness(rows: DataFrame, names: Column, source: Column) -> DataFrame:
    """`rows` with claimed, ungrounded (names, in order) and score; 1.0 if nothing is claimed."""
    out = rows.withColumns({"_names": names, "_form": groundedness_form(source)})
    out = out.withColumn("ungrounded", F.filter("_names", lambda n: ~is_grounded(n, F.col("_form"))))
    claimed = F.size("_names")
    score = F.when(claimed == 0, 1.0).otherwise((claimed - F.size("ungrounded")) / claimed)
    return out.withColumns({"claimed": claimed, "score": score}).drop("_names", "_form")


def known_outputs(cached: DataFrame, model: str | None = None) -> DataFrame:
    """task_id, raw_output: one cached answer for each task, of the model alone if the cache names models."""
    own = cached.filter(F.col("model").eqNullSafe(F.lit(model))) if "model" in cached.columns else cached
    return own.groupBy("task_id").agg(F.min("raw_output").alias("raw_output"))


def evaluate(references: DataFrame, generate: Callable[[Column], Column], cached: DataFrame | None = None, model: str | None = None, store: AnswerStore | None = None) -> DataFrame:
    """References with raw_output, json_valid, schema_errors, schema_valid and groundedness, written once.

    `generate` gives the model's answer to a source. Answers in `cached`
    (task_id, raw_output, and model if it holds several) and in `store` are used
    again; only the others are generated, once each.
    """
    store = store or AnswerStore(references.sparkSession)
    asked = lambda rows: store.ask(rows, f"model:{model or ''}", F.col("source_content"), generate, "_answer").withColumn("raw_output", F.col("_answer.text")).drop("_answer")
    if cached is None:
        rows = asked(references)
    else:
        known = known_outputs(cached, model)
        rows = references.join(known, "task_id").unionByName(asked(references.join(known, "task_id", "left_anti")))
    rows = materialise(rows.withColumn("_checked", checked(F.col("raw_output"))), "evaluated")
    rows = rows.withColumns({"schema_errors": F.col("_checked.errors"), "json_valid": F.col("_checked.json").isNotNull(), "schema_valid": F.size("_checked.errors") == 0})
    scored = with_groundedness(rows, F.coalesce(claimed_names(F.col("_checked.json")), F.array().cast("array<string>")), F.col("source_content"))
    return scored.withColumns({c: F.when(F.col("json_valid"), F.col(c)) for c in ("score", "claimed", "ungrounded")}).drop("_checked")


def judge(rows: DataFrame, ask: Callable[[Column], Column], cached: DataFrame | None = None, judge_name: str | None = None, store: AnswerStore | None = None) -> DataFrame:
    """Evaluated rows with the rubric's scores and judge_error, written once.

    `ask` gives a judge's answer (struct text, error) to a prompt of source and
    output; only outputs that are valid JSON are judged. An answer that failed,
    is no object or lacks a score of 1 to 5 is an error of its row, without
    scores. Verdicts in `cached` (task_id, judge_name, raw_output, answer) and in
    `store` are used again for the same judge and output.
    """
    store = store or AnswerStore(rows.sparkSession)
    prompt = F.concat_ws("\n\n", F.lit("Rate how well the notes keep to the source."), F.col("source_content"), F.col("raw_output"))
    answered = lambda some: store.ask(some, f"judge:{judge_name or ''}", prompt, ask)
    asked = rows.filter("json_valid")
    if cached is None:
        given = answered(asked)
    else:
        keys = ["task_id", "raw_output"]
        known = cached.filter(F.col("judge_name").eqNullSafe(F.lit(judge_name))).groupBy(*keys).agg(F.min(F.struct("answer.text", "answer.error")).alias("_known"))
        new = answered(asked.join(known, keys, "left_anti"))
        old = asked.join(known, keys).withColumn("answer", F.struct("_known.text", "_known.error", F.lit(None).cast("int").alias("input_tokens"), F.lit(None).cast("int").alias("output_tokens"))).drop("_known")
        given = old.unionByName(new)
    read = materialise(given.withColumn("_read", checked(F.col("answer.text"))), "judged").withColumn("_verdict", verdict(F.try_parse_json("_read.json")))
    error = F.coalesce(F.col("answer.error"), F.col("_read.error"), F.col("_verdict.error"))
    scored = read.withColumn("judge_error", error).withColumns({k: F.when(F.col("judge_error").isNull(), F.col(f"_verdict.{k}")) for k in RUBRIC})
    none = rows.filter("not json_valid").withColumns({"answer": F.lit(None).cast(read.schema["answer"].dataType), "judge_error": F.lit(None).cast("string")} | {k: F.lit(None).cast("int") for k in RUBRIC})
    return scored.drop("_read", "_verdict").unionByName(none)


def rounded(row: DataFrame) -> DataFrame:
    """Metrics as they are reported: rates and groundedness to four digits, the judge's means to three."""
    digits = lambda c: 3 if c.startswith("judge_") else 4
    return row.select(*[F.round(c, digits(c)).alias(c) if kind == "double" else F.col(c) for c, kind in row.dtypes])


def write_metrics(row: DataFrame, path: str) -> None:
    """Write the rounded metrics as one line of JSON."""
    rounded(row).coalesce(1).write.mode("overwrite").json(path)


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Rates and means over evaluated rows (json_valid, schema_valid, score, and the rubric's scores if judged)."""
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    judged = [k for k in RUBRIC if k in rows.columns]
    extra = [F.count(judged[0]).alias("judged_tasks")] if judged else []
    return rows.groupBy(*by).agg(
        F.count("*").alias("tasks"), rate("json_valid").alias("json_valid_rate"), rate("schema_valid").alias("schema_valid_rate"), F.avg("score").alias("mean_groundedness"),
        *extra, *[F.avg(k).alias(f"judge_{k}") for k in judged],
    )


def compare(by_model: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """A row for each metric and a column for each model; `-` where there is none."""
    long = by_model.select("model", *[F.col(k).cast("string").alias(k) for k in keys]).unpivot("model", keys, "metric", "value")
    wide = long.groupBy("metric").pivot("model", models).agg(F.first("value"))
    return wide.select("metric", *[F.coalesce(F.col(f"`{m}`"), F.lit("-")).alias(m) for m in models])
