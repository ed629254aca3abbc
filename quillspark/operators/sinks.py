"""Sinks: packs as JSON, indexes and tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in ranges of the columns that there are, each range in order; files are named in the order of the ranges."""
    order = [c for c in columns if c in df.columns]
    return df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df


def write_pack(manifest: DataFrame, documents: DataFrame, tasks: DataFrame, index: DataFrame, path: str) -> list[str]:
    """The four artifacts of a source pack below `path`; tasks keep the order of priority and id."""
    ordered(manifest, "priority", "source_id").write.mode("overwrite").json(f"{path}/manifest_normalized")
    spread = ["source", *[c for c in ("document_id", "local_path", "path") if c in documents.columns][:1]]
    documents.withColumn("source", F.col("source_id")).repartitionByRange(*spread).write.mode("overwrite").partitionBy("source").json(f"{path}/documents")
    # The id parts the many tasks of a source that share an index, most of all the first.
    ordered(tasks, "priority", "source_id", "chunk_index", "task_id").write.mode("overwrite").json(f"{path}/study_note_tasks")
    ordered(index, "source_id").write.mode("overwrite").json(f"{path}/source_pack")
    return [f"{path}/{n}" for n in ("manifest_normalized", "documents", "study_note_tasks", "source_pack")]


def playlist_index(entries: DataFrame, title: Column) -> DataFrame:
    """text for each playlist: a heading and numbered links with their minutes."""
    minutes = F.when(F.col("duration").isNotNull(), F.concat(F.lit(" ("), F.round(F.col("duration") / 60).cast("int").cast("string"), F.lit(" min)"))).otherwise("")
    line = F.concat(F.col("pos").cast("string"), F.lit(". ["), "title", F.lit("]("), "url", F.lit(")"), minutes)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n")
    return entries.groupBy("playlist_id").agg(F.concat(F.lit("# "), F.first(title), F.lit("\n\n"), body).alias("text"))


def transcript_text(sections: Column) -> Column:
    """Paragraphs of a transcript."""
    return F.array_join(F.transform(sections, lambda s: s["text"]), "\n\n")


def modelfile(base: str, system_prompt: str, parameters: dict[str, str]) -> str:
    """A prompt template for a local model server, the system prompt verbatim."""
    rows = [f"FROM {base}", *[f"PARAMETER {k} {v}" for k, v in parameters.items()], f'SYSTEM """{system_prompt}"""']
    return "\n".join(rows) + "\n"


def artifact_report(spark, paths: dict[str, str]) -> DataFrame:
    """name, exists, bytes, lines of artifacts, missing ones too."""
    rows = []
    for name, path in paths.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        there = system.exists(at)
        size = system.getContentSummary(at).getLength() if there else 0
        count = spark.read.option("recursiveFileLookup", "true").text(path).filter("trim(value) <> ''").count() if there else 0
        rows.append((name, there, size, count))
    return spark.createDataFrame(rows, "name string, exists boolean, bytes long, lines long")
