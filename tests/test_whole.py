"""Queries that read whole texts and groups, against brute force."""

import hashlib
import re

from pyspark.sql import functions as F

from quillspark import storage
from quillspark.operators import transcript
from quillspark.plans import catalogue


def write(spark, folder, name, rows, schema) -> str:
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_all_segments_of_a_transcript_are_merged(spark, tmp_path):
    text = " ".join("w" + chr(97 + i // 26 % 26) + chr(97 + i % 26) + chr(97 + i // 676) for i in range(1000)) + " no1 (end) über\u00a0alles, well."
    folder = write(spark, tmp_path, "documents", [(1, text), (2, "one two"), (3, "")], "doc_id long, text string")
    want = set()
    for i, t in ((1, text), (2, "one two"), (3, "")):
        words = t.split()
        at = lambda k: k * 9.0 + k // 7 * 20
        segments = [{"text": " ".join(words[8 * k : 8 * k + 8]), "start_time_s": at(k), "end_time_s": at(k) + 9} for k in range(len(words) // 8 + 1)]
        for s in transcript.merge_segments(segments):
            want.add((i, s["index"], s["start_time_s"], s["end_time_s"], hashlib.sha256(s["text"].encode()).hexdigest()))
    got = {tuple(r) for r in catalogue.QUERIES["transcript_merge"](spark, folder).collect()}
    assert got == want
    assert max(e for i, _, _, e, _ in got if i == 1) == at(1005 // 8) + 9


def test_every_entry_of_a_playlist_is_expanded(spark, tmp_path):
    rows = [(i, f"text {i}", "hot" if i % 10 else "cold") for i in range(1, 300)]
    folder = write(spark, tmp_path, "documents", rows, "doc_id long, text string, source string")
    want = {(f"video_{s}_playlist", 50, False) for s in ("hot", "cold")}
    for source in ("hot", "cold"):
        ids = [i for i, _, s in rows if s == source]
        want |= {(f"pl_{source}_{pos:02d}_talk_{i}", 50 + pos, True) for pos, i in enumerate(ids, 1) if i % 7}
    got = [tuple(r) for r in catalogue.QUERIES["playlist_expand"](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cues_are_parsed_whole(spark, tmp_path):
    turns = [(1, 0, "word " * 500 + "end"), (1, 1, "short"), (2, 3, "a\nb " * 300 + "<i>last</i>")]
    folder = write(spark, tmp_path, "conversations", turns, "conv_id long, turn int, text string")
    said = [" ".join(re.sub("<[^>]+>", "", t).split()) + " and more" for *_, t in turns]
    want = {(c, cue, t * 70 + 0.25, t * 70 + 9.5, hashlib.sha256(s.encode()).hexdigest()) for (c, t, _), cue, s in zip(turns, (0, 1, 0), said, strict=True)}
    assert {tuple(r) for r in catalogue.QUERIES["vtt_parse"](spark, folder).collect()} == want


def test_overlap_reads_both_whole_halves(spark, tmp_path):
    words = [f"v{i}" for i in range(300)]
    rows = [(45 + k, " ".join([*words, *words[300 - k :], *[f"x{i}" for i in range(300 - k)]])) for k in (0, 7, 30)]
    folder = write(spark, tmp_path, "documents", rows, "doc_id long, text string")
    assert {tuple(r) for r in catalogue.QUERIES["overlap_words"](spark, folder).collect()} == {(45, 0), (52, 7), (75, 30)}


def test_a_folder_of_lines_is_written_by_many_tasks(spark, tmp_path):
    """A tenth of the tasks would otherwise write all lines of the five folders; files and lines keep their order."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.repeat(F.lit("word "), 40).alias("text"))
    rows.write.parquet(f"{tmp_path}/in/documents.parquet")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [r["doc_id"] for r in catalogue.QUERIES["first_lines"](spark, f"{tmp_path}/in").collect()]
        files = spark.read.text(storage._written[-1]).groupBy(F.input_file_name()).count().collect()
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value) if value is not None else spark.conf.unset(setting)
    assert got == list(range(3995, 3795, -5))
    assert len(files) >= 40 and max(r["count"] for r in files) < 400


def test_transcripts_go_to_python_in_small_batches(spark, tmp_path):
    """Of thousands of short transcripts no more than a thousand are in Python at once."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "10000")
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = F.pandas_udf(lambda own: own * 0 + len(own), "long")
    try:
        merged = catalogue.QUERIES["transcript_merge"](spark, str(tmp_path))
        assert merged.count() == 5000
        assert rows.coalesce(1).select(F.max(sizes("doc_id"))).first()[0] <= 1000
    finally:
        spark.conf.set(setting, before)


def test_a_pack_chunks_once_and_spreads_its_first_chunks(spark, tmp_path, monkeypatch):
    """Chunks are written before they are ranged and counted, and documents of one source and one chunk share no task."""
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 30).alias("text"), F.lit("src1").alias("source"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    chunked, written = [], []
    own, write_pack = catalogue.packed, catalogue.sinks.write_pack
    monkeypatch.setattr(catalogue, "packed", lambda *a: chunked.append(a) or own(*a))

    def watched(manifest, documents, tasks, index, path):
        assert not any("aggregate(" in df._jdf.queryExecution().optimizedPlan().toString() for df in (tasks, index))
        written.append(path)
        return write_pack(manifest, documents, tasks, index, path)

    monkeypatch.setattr(catalogue.sinks, "write_pack", watched)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["name"]: (r["there"], r["lines"]) for r in catalogue.QUERIES["pack_files"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before) if before is not None else spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {"documents": (True, 2000), "tasks": (True, 2000), "index": (True, 1), "gone": (False, 0)} and len(chunked) == 1
    sizes = [r["count"] for r in spark.read.text(f"{written[0]}/study_note_tasks").groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 1000
