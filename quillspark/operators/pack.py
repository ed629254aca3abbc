"""Source packs: tasks from chunks, and an index of what went in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import preview


def document_id(source_id: Column, path: Column) -> Column:
    """An id that the source and its path decide, so that runs repeat."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws("|", source_id, path), 256), 1, 8))


def task_id(pack_id: str, source_id: Column, chunk_index: Column) -> Column:
    return F.concat(F.lit(f"{pack_id}__"), source_id, F.lit("__c"), F.format_string("%04d", chunk_index))


def build_prompt(template: str, content: Column, schema_json: str, content_mark: str = "{{CONTENT}}", schema_mark: str = "{{SCHEMA}}") -> Column:
    """The template with its schema and content, both taken literally."""
    return F.replace(F.lit(template.replace(schema_mark, schema_json)), F.lit(content_mark), content)


def retry_prompt(prompt: Column, errors: Column, intro: str = "The last answer was rejected:") -> Column:
    """The prompt again, with what was wrong."""
    return F.concat(prompt, F.lit(f"\n\n{intro}\n"), F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e)), "\n"))


def tasks(chunks: DataFrame, pack_id: str, template: str, schema_json: str) -> DataFrame:
    """A task for each chunk: `chunks` has source_id and the columns of chunks."""
    only = lambda c: F.when(F.size(c) == 1, F.get(F.col(c), F.lit(0)))
    return chunks.select(
        task_id(pack_id, F.col("source_id"), F.col("chunk_index")).alias("task_id"), "*",
        only("source_section_indexes").alias("section_index"), only("source_headings").alias("section_heading"),
        F.col("text").alias("source_content"), build_prompt(template, F.col("text"), schema_json).alias("prompt"),
    ).withColumnRenamed("word_count", "chunk_word_count").drop("text")


PROVENANCE = ("source_id", "resource_type", "original_url", "topic_bucket_ids", "priority", "split", "description", "notes")


def with_provenance(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents (source_id, format_metadata: JSON) with their source's record in the metadata."""
    known = [c for c in PROVENANCE if c in sources.columns]
    record = sources.select("source_id", F.to_json(F.struct(*known), {"ignoreNullFields": "false"}).alias("_record"))
    joined = documents.join(record, "source_id", "left")
    own = F.regexp_replace(F.coalesce("format_metadata", F.lit("{}")), r"\}\s*\z", "")
    comma = F.when(F.trim(own) == "{", "").otherwise(",")
    return joined.withColumn("format_metadata", F.concat(own, comma, F.lit('"source_pack":'), F.coalesce("_record", F.lit("null")), F.lit("}"))).drop("_record")


def index_sources(sources: DataFrame, sections: DataFrame, chunks: DataFrame, least_words: int = 120) -> DataFrame:
    """Counts for each source (source_id); zeros for those that gave nothing."""
    by_section = sections.groupBy("source_id").agg(F.count("*").alias("section_count"), F.sum("word_count").alias("word_count"))
    by_chunk = chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"), F.count_if(F.col("word_count") < least_words).alias("low_quality_chunk_count"))
    counts = ["section_count", "word_count", "chunk_count", "low_quality_chunk_count"]
    return sources.join(by_section, "source_id", "left").join(by_chunk, "source_id", "left").fillna(0, counts)


def index_totals(indexed: DataFrame) -> DataFrame:
    """One row of totals; skipped sources count as such only."""
    own = ~F.col("skipped")
    total = lambda c: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).alias(f"total_{c}")
    return indexed.agg(F.count("*").alias("source_count"), F.count_if(own).alias("ingested_source_count"), F.count_if(~own).alias("skipped_source_count"), total("section_count"), total("word_count"), total("chunk_count"))


def bucket_counts(sources: DataFrame, buckets: DataFrame) -> DataFrame:
    """Sources of each topic bucket, skipped ones too; repeated ids count each time."""
    named = sources.select(F.explode("topic_bucket_ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return buckets.select("id").join(named, "id", "full").select("id", F.coalesce("n", F.lit(0)).alias("source_count"))


def flagged(tasks: DataFrame, least_words: int = 120) -> DataFrame:
    """Tasks of fewer words; a missing count is none."""
    return tasks.filter(F.coalesce("chunk_word_count", F.lit(0)) < least_words)


def audit(tasks: DataFrame, least_words: int = 120) -> DataFrame:
    """Flagged tasks of each source, most first."""
    source = F.coalesce(F.nullif("source_id", F.lit("")), F.lit("(unknown)"))
    return flagged(tasks, least_words).groupBy(source.alias("source_id")).agg(F.count("*").alias("flagged")).orderBy(F.desc("flagged"), "source_id")


def audit_preview(tasks: DataFrame, least_words: int = 120, limit: int = 20, chars: int = 120) -> DataFrame:
    """The first flagged tasks by id, with the beginning of their content."""
    rows = flagged(tasks, least_words).orderBy("task_id").limit(limit)
    return rows.select("task_id", "chunk_word_count", "source_id", preview(F.col("source_content"), chars).alias("preview"))
