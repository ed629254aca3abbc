"""Training pairs and references from tasks and their notes, without leaks between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import hash_fraction

REFERENCE_SPLITS = ("eval", "holdout")
UNENRICHED, OTHER = "skipped_unenriched", "skipped_other_split"
BUCKETS = ("train", "valid", *REFERENCE_SPLITS, UNENRICHED, OTHER)

#: What a trained model is told, unless a pack brings its own: pairs and served models must hold the same words.
SYSTEM_PROMPT = (
    "You turn one excerpt of a document into a study note. Use only what the excerpt says; leave out what it does not. "
    "Keep names of features, tools and parameters as they are written. Answer with a single JSON object of the agreed fields and nothing around it."
)


class ExportError(ValueError):
    """No training pairs."""


def bucket(split: Column, task_id: Column, enriched: Column, valid_fraction: float) -> Column:
    """Where a task goes; the key alone decides between train and valid."""
    own = F.when(split == "train", F.when(hash_fraction(task_id) < valid_fraction, "valid").otherwise("train"))
    return F.when(~enriched, UNENRICHED).otherwise(F.coalesce(own, F.when(split.isin(*REFERENCE_SPLITS), split), F.lit(OTHER)))


def route(tasks: DataFrame, notes: DataFrame, valid_fraction: float = 0.05) -> DataFrame:
    """Tasks with their note and `bucket`; notes are (task_id, study_note)."""
    joined = tasks.join(notes.select("task_id", "study_note"), "task_id", "left")
    return joined.withColumn("bucket", bucket(F.col("split"), F.col("task_id"), F.col("study_note").isNotNull(), valid_fraction))


def training_pairs(routed: DataFrame, system_prompt: str) -> DataFrame:
    """task_id, bucket, messages of the rows for training and validation."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("system", F.lit(system_prompt)), message("user", F.col("source_content")), message("assistant", F.col("study_note")))
    return routed.filter(F.col("bucket").isin("train", "valid")).select("task_id", "bucket", messages.alias("messages"))


def references(routed: DataFrame) -> DataFrame:
    """Rows of the splits that are kept for evaluation."""
    kept = ["task_id", "split", "source_id", "topic_bucket_ids", "source_content"]
    return routed.filter(F.col("bucket").isin(*REFERENCE_SPLITS)).select(*kept, F.col("study_note").alias("reference_note"))


def counts(routed: DataFrame) -> DataFrame:
    """One row: how many tasks went where."""
    return routed.agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])


def write_export(routed: DataFrame, path: str, system_prompt: str) -> DataFrame:
    """Write pairs and references below `path` as JSON, by bucket, and return the counts."""
    summary = counts(routed).withColumn("canonical_prompt_sha256", F.sha2(F.lit(system_prompt), 256))
    row = summary.first()
    if not row["train"]:
        raise ExportError("there are no training pairs; has the enrichment been run?")
    for frame, name in ((training_pairs(routed, system_prompt), "pairs"), (references(routed).withColumn("bucket", F.col("split")), "references")):
        ordered = frame.repartitionByRange("bucket", "task_id").sortWithinPartitions("bucket", "task_id")  # a bucket of any size, in order over its files
        ordered.write.mode("overwrite").partitionBy("bucket").json(f"{path}/{name}")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return summary


def force_train(split: Column) -> Column:
    """Tasks that belong to no split are for training."""
    return F.when(split.isNull() | split.isin("", "unassigned"), "train").otherwise(split)


def within_length(rows: DataFrame, tokens: Column, most: int = 4096) -> DataFrame:
    """Rows that a model's context holds; `tokens` counts or estimates."""
    return rows.filter(tokens <= most)


def estimated_tokens(text: Column, per_word: float = 4 / 3) -> Column:
    """Tokens by the number of words, for want of a tokenizer."""
    from quillspark.functions.text import word_count

    return F.ceil(word_count(text) * per_word).cast("int")


def backfilled(pairs: DataFrame, needed: tuple[str, ...] = ("valid", "test")) -> DataFrame:
    """Pairs with a copy of the training rows for each needed bucket that is empty, for smoke runs."""
    there = {r["bucket"] for r in pairs.select("bucket").distinct().collect()}  # a handful of buckets
    if "train" not in there:
        raise ExportError("there are no training pairs")
    out = pairs
    for name in needed:
        if name not in there:
            out = out.unionByName(pairs.filter("bucket = 'train'").withColumn("bucket", F.lit(name)))
    return out
