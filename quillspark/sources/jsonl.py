"""Files of one JSON object a line, with a schema, in the order of their lines.

Blank lines are left out; a line that is no object of the schema is an error of
the read, not a row of nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a task needs to be enriched, and a reference to be evaluated.
TASK = "task_id string, split string, source_id string, prompt string, source_content string, topic_bucket_ids array<string>"
REFERENCE = "task_id string, split string, source_id string, topic_bucket_ids array<string>, source_content string, reference_note string"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, order: str | None = "ord") -> DataFrame:
    """Rows of `schema`, with their place in column `order`: file, where its block begins, and a number that grows within the block.

    A file that is read by several tasks is cut to blocks, and the rows of a
    block come in order in one task, so the places sort as the lines stand.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if order is None:
        return rows
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias(order))
