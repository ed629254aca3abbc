"""Operators and sources by small examples."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import discovery, enrichment, evaluation, export, pack, sinks, transcript, validation
from quillspark.sources import documents, files, manifest, slides
from quillspark.sources import sections as S
from quillspark.streaming import incremental


def one(spark, column, **values):
    """The value of a column over one row of strings."""
    names = list(values) or ["x"]
    df = spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("v")).first()["v"]


# Text


def test_words_are_those_of_python(spark):
    for text in ("", "  ", "a b", "a b　c\x85d", "a\x0bb\x1cc", "﻿a", "x​y"):
        assert one(spark, T.word_count(F.col("x")), x=text) == len(text.split()), text
        assert one(spark, T.strip(F.col("x")), x=text) == text.strip()


def test_clean_text(spark):
    assert one(spark, T.clean_text(F.col("x")), x=" a \t b\r\n\r\n \r\nc\rd \n") == "a b\n\nc\nd"
    assert one(spark, T.clean_slide_text(F.col("x")), x="a\tb\n\n  c  d \n") == "a b\nc d"
    assert one(spark, T.clean_markdown(F.col("x")), x="# t  \n\n\n\n  code\n") == "# t\n\n  code"


def test_headings(spark):
    levels = {"# a": 1, "  ### a ##": 3, "####### a": 0, "#a": 0, "#": 0, "# #": 1, "text": 0}
    for line, level in levels.items():
        assert one(spark, T.heading_level(F.col("x")), x=line) == level, line
    assert one(spark, T.heading_text(F.col("x")), x="  ### a b ##") == "a b"
    md = "## second\n```\nx\n```\n# first\n~~~\n"
    assert one(spark, T.markdown_title(F.col("x"), F.lit("f")), x=md) == "first"
    assert one(spark, T.markdown_title(F.col("x"), F.lit("f")), x="\n short line\n") == "short line"
    assert one(spark, T.markdown_title(F.col("x"), F.lit("f")), x="w " * 16) == "f"
    assert one(spark, T.code_block_count(F.col("x")), x=md) == 1 and one(spark, T.heading_count(F.col("x")), x=md) == 2


def test_garbage(spark):
    good, bad = ["plain text, really.", "Größe 12 · ok"], ["", "  \n", "�" * 3 + "abc", "-- .. ;; !!", "ab\x00\x01\x02"]
    assert [one(spark, T.is_garbage(F.col("x")), x=t) for t in good + bad] == [False] * 2 + [True] * 5


def test_grounded_names(spark):
    def grounded(name, source):
        return one(spark, T.is_grounded(F.col("n"), T.groundedness_form(F.col("s"))), n=name, s=source)

    assert grounded("`Time Travel`", "uses time   travel") and grounded("lake (travel)", "travel over a lake")
    assert not grounded("time machine", "uses time travel") and not grounded("a b", "c") and grounded(" ' ", "")


def test_overlap_and_append(spark):
    assert one(spark, T.word_overlap(F.col("a"), F.col("b")), a="we go home, Now", b="home now and then") == 2
    assert one(spark, T.word_overlap(F.col("a"), F.col("b")), a="", b="x") == 0
    assert transcript.appended("we go home, now", "home now and then") == "we go home, now and then"
    assert transcript.appended("A big  house", "big house") == "A big  house" and transcript.appended("", " x ") == "x"


def test_slug_and_keys(spark):
    assert one(spark, T.slug(F.col("x"), "index", 8), x="/A b--c d!") == "a_b_c_d"
    assert one(spark, T.slug(F.col("x"), "index", 6), x="ab cde fg") == "ab_cde" and one(spark, T.slug(F.col("x"), "index"), x="!!") == "index"
    assert len(one(spark, T.request_key(F.col("x")), x="x" * 98)) == 32


# Sections


def test_text_sections(spark):
    got = one(spark, S.text_sections(F.col("x")), x="Title\r\n\r\nfirst  part\n \nsecond\tpart\n")
    assert [(s["index"], s["text"], s["raw_text"]) for s in got] == [(0, "Title", "Title"), (1, "first part", "first  part"), (2, "second part", "second\tpart")]


def test_sections_are_made_once(spark):
    """Paragraphs of a text are neither cut anew for each of them nor made again to be counted."""
    docs = spark.createDataFrame([(1, "a \t b\n\n\tc  d "), (2, None), (3, " \n ")], "k int, x string")
    rows = S.exploded(docs, S.text_sections(F.col("x")), "k")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 3  # lines, paragraphs and raw paragraphs
    assert [(r["k"], r["index"], r["text"], r["raw_text"]) for r in rows.collect()] == [(1, 0, "a b", "a \t b"), (1, 1, "c d", "c  d")]
    assert one(spark, T.clean_text(F.col("x")), x="a b  c\td \te\t f\t\tg   h\n\t i\t") == "a b c d e f g h\ni"


def test_markdown_sections(spark):
    body = " ".join(["word"] * 15)
    text = f"{body} intro\n# One\n{body}\n## Empty\n## Two ##\n\n{body} two\n### Thin\nfew words\n"
    got = one(spark, S.markdown_sections(F.col("x")), x=text)
    assert [(s["index"], s["heading"], s["text"]) for s in got] == [(0, None, f"{body} intro"), (1, "One", body), (2, "Two", f"{body} two")]
    assert one(spark, S.markdown_sections(F.col("x")), x="# a\n## b") == []


def test_captions(spark):
    vtt = "WEBVTT\n\nNOTE x\n\n1\n00:01.000 --> 00:02.500 line:0\n<v A>Fish &amp;\n<00:01.500>chips</v>\n\n01:00:00,250 --> 01:00:01.000\n \n\nno time\n\n1:00:02.000 --> 1:00:03.000\nend"
    got = one(spark, S.vtt_sections(F.col("x")), x=vtt)
    assert [(s["text"], s["start_time_s"], s["end_time_s"]) for s in got] == [("Fish & chips", 1.0, 2.5), ("end", 3602.0, 3603.0)]


def test_transcripts_are_merged():
    seg = lambda t, a, b: {"text": t, "start_time_s": a, "end_time_s": b}
    got = transcript.merge_segments([seg("we go home", 0, 4), seg("go home now", 4, 8), seg(" ", 8, 9), seg("later", 20, 21), seg("lost", None, None), seg("x " * 99, 21, 22)])
    assert [(s["text"][:14], s["start_time_s"], s["end_time_s"]) for s in got] == [("we go home now", 0, 8), ("later lost", 20, None), ("x x x x x x x ", 21, 22)]


# Files


def test_folders_are_scanned(spark, tmp_path):
    for name in ("b/two.MD", "a.txt", "a-b/c.txt", "_kept.txt", ".hidden.txt", ".dir/x.txt", "__MACOSX/x.txt", "Thumbs.db", "x.xyz"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text("Title\n\nText of the file.")

    def scan(**how):
        found, others = files.scan(spark, f"file://{tmp_path}", **how)
        return sorted(r["path"] for r in found.collect()), others

    assert scan() == (["_kept.txt", "a-b/c.txt", "a.txt", "b/two.MD"], 1) and scan(recursive=False) == (["_kept.txt", "a.txt"], 1)
    assert files.list_files(spark, f"file://{tmp_path}") == ["_kept.txt", "a-b/c.txt", "a.txt", "b/two.MD", "x.xyz"]
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, f"file://{tmp_path}/none")
    with pytest.raises(NotADirectoryError):
        files.list_files(spark, f"file://{tmp_path}/a.txt")
    with pytest.raises(ValueError, match="Supported"):
        files.read_documents(spark, f"file://{tmp_path}", files.list_tree(spark, f"file://{tmp_path}"))
    got = files.read_documents(spark, str(tmp_path), ["a.txt"]).first()
    assert got["title"] == "Title" and [s["text"] for s in got["sections"]] == ["Title", "Text of the file."]


def test_bytes_are_decoded(spark):
    df = spark.createDataFrame([(bytearray("é\r\nx".encode()),), (bytearray("é".encode("latin-1")),), (bytearray(b"\xef\xbb\xbfa"),)], "b binary")
    assert [r[0] for r in df.select(files.decoded(F.col("b"))).collect()] == ["é\nx", "é", "﻿a"]


def test_suffixes_are_routed():
    assert files.route("x/a.TXT") == ".txt"
    for path in ("a.xyz", "noext", ".txt", "a.mp3"):
        with pytest.raises(ValueError, match="Supported"):
            files.route(path)
    with pytest.raises(ValueError, match="already"):
        files.register(".txt", slides.read_pptx)


def test_slides_are_read(spark, tmp_path):
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    para = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    shape = lambda t, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{para(t)}</p:txBody></p:sp>"
    table = f"<p:graphicFrame><a:tbl><a:tr><a:tc>{para('k')}</a:tc><a:tc>{para('v')}</a:tc></a:tr></a:tbl></p:graphicFrame>"
    slide = lambda body: f"<p:sld {ns}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide(shape("Hello", '<p:ph type="title"/>') + f"<p:grpSp>{shape('in a group')}</p:grpSp>" + table))
        z.writestr("ppt/slides/slide2.xml", slide(""))
        z.writestr("ppt/slides/slide10.xml", slide(shape("last")))
        z.writestr("ppt/slides/_rels/slide1.xml.rels", '<R><Relationship Type="http://x/notesSlide" Target="../notesSlides/n1.xml"/></R>')
        z.writestr("ppt/notesSlides/n1.xml", slide(shape("say this", '<p:ph type="body"/>') + shape("1", '<p:ph type="sldNum"/>')))
    (tmp_path / "deck.pptx").write_bytes(raw.getvalue())
    files.register(".pptx", slides.read_pptx)
    got = files.read_documents(spark, f"file://{tmp_path}", ["deck.pptx"]).first()["sections"]
    assert [(s["index"], s["slide_number"], s["text"]) for s in got] == [(0, 1, "Slide title: Hello\n\nin a group\nk | v\n\nSpeaker notes:\nsay this"), (1, 10, "last")]


# Manifests and documents

GOOD = {
    "manifest_version": "1.0", "pack_id": "p", "title": "T", "domain": "d", "topic_buckets": [{"id": "x", "label": "X"}],
    "sources": [{"source_id": "b", "title": "B", "resource_type": "article", "local_path": "b.md", "topic_bucket_ids": ["x"]}, {"source_id": "a", "title": "A", "resource_type": "article", "local_path": "a.md", "topic_bucket_ids": ["x"], "priority": 100, "split": "eval"}, {"source_id": "off", "title": "O", "resource_type": "article", "local_path": "o.md", "topic_bucket_ids": ["x"], "enabled": False}],
}


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps(GOOD))
    rows = manifest.read_manifest(spark, str(path))
    assert rows.select(manifest.manifest_errors(rows)).first()[0] == []
    missing = F.array(F.lit("a.md"), F.lit("o.md"))
    assert rows.select(manifest.manifest_errors(rows, missing)).first()[0] == ["sources[1].local_path does not exist"]
    enabled = manifest.enabled_sources(rows)
    assert [(r["source_id"], r["split"], r["priority"]) for r in enabled.collect()] == [("a", "eval", 100), ("b", "unassigned", 100)]
    listed = manifest.with_existing(enabled, spark.createDataFrame([("a.md",)], "path string")).collect()
    assert {r["source_id"]: r["skipped"] for r in listed} == {"a": False, "b": True}
    bad = GOOD | {"title": " ", "topic_buckets": [{"id": "x", "label": "X"}, {"id": "x", "label": ""}], "sources": [GOOD["sources"][0] | {"enabled": "yes", "priority": 1.5, "topic_bucket_ids": ["y", " "]}] * 2}
    path.write_text(json.dumps(bad))
    errors = (rows := manifest.read_manifest(spark, str(path))).select(manifest.manifest_errors(rows)).first()[0]
    assert errors[:3] == ["title must be a non-empty string", "topic_buckets[1].id is a duplicate", "topic_buckets[1].label must be a non-empty string"]
    assert "sources[1].source_id is a duplicate" in errors and "sources[0].priority must be an integer" in errors and len(errors) == 3 + 4 + 5


def test_documents_are_checked(spark, tmp_path):
    doc = {k: "x" for k in documents.REQUIRED} | {"sections": [{"index": 0, "text": "t"}], "schema_version": "1.0", "format_metadata": {"pages": [1, {"a": None}]}}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    row = documents.load_documents(spark, f"{tmp_path}/d.json").first()
    assert row["sections"][0]["text"] == "t" and row["format_metadata"].toPython() == {"pages": [1, {"a": None}]}
    (tmp_path / "e.json").write_text(json.dumps(doc | {"schema_version": "0.9"}))
    with pytest.raises(documents.SchemaVersionError):
        documents.load_documents(spark, f"{tmp_path}/e.json")
    bad = doc | {"zzz": 1, "document_id": "", "sections": [{"index": -1, "text": "t", "q": 1}]}
    del bad["method"]
    errors = spark.createDataFrame([(json.dumps(bad),)], "j string").select(documents.document_errors(F.col("j"))).first()[0]
    assert errors == ["unknown key: zzz", "missing key: method", "document_id must be a non-empty string", "sections[0]: unknown key: q", "sections[0]: index must be an integer of at least 0"]


# Notes, enrichment, export, evaluation

NOTE = {
    "title": "t", "summary": "s", "key_concepts": [{"concept": "river", "simple_explanation": "e", "why_it_matters": "w"}],
    "important_features_or_tools": [{"name": "water wheel", "type": "t", "what_it_does": "w", "when_to_use_it": "u", "important_parameters": [{"parameter": "depth", "meaning": "m", "example_value": None}]}],
    "practical_workflow": [{"step": True, "action": "a", "reason": "r"}], "common_mistakes_or_confusions": [], "project_usage_notes": ["n"],
}


def test_notes_are_checked():
    assert validation.note_problems(NOTE) == []
    bad = NOTE | {"title": 1, "key_concepts": ["x"], "practical_workflow": [{"step": 1.0, "action": "", "reason": "r"}], "project_usage_notes": None, "b": 1, "a": 1}
    assert validation.note_problems(bad) == [
        "title must be a non-empty string", "key_concepts[0] must be an object", "practical_workflow[0].step must be an integer",
        "practical_workflow[0].action must be a non-empty string", "project_usage_notes must be a list", "unknown keys: a, b",
    ]
    assert validation.parse_object('x {"a": 1} y') == ({"a": 1}, None) and validation.parse_object("[1]")[0] is None
    assert validation.parse_object('{"a": NaN, "b": 1, "b": 2}')[0]["b"] == 2 and validation.parse_object('{"a": 1} {"b": 2}')[1]


def tasks(spark, n=40):
    return spark.createDataFrame([(f"t{i:02d}", "train" if i % 10 else "eval", "src", f"prompt {i}", "the river turns a water wheel") for i in range(n)], "task_id string, split string, source_id string, prompt string, source_content string")


def model(prompt):
    """Fails for 1, mends 2 on the second call, never does 3."""
    number = F.regexp_extract(prompt, r"prompt (\d+)", 1)
    again = prompt.contains("rejected")
    text = F.when((number == "2") & ~again, "{").when(number == "3", "nonsense").otherwise(f"```json\n{json.dumps(NOTE)}\n```")
    failed = (number == "1") & ~again
    return F.struct(F.when(~failed, text).alias("text"), F.when(failed, "timeout").alias("error"), F.lit(7).alias("input_tokens"), F.lit(None).cast("int").alias("output_tokens"))


def test_enrichment(spark, tmp_path):
    every, none = tasks(spark), spark.createDataFrame([], "task_id string")
    row = enrichment.run(every, none, none, model, str(tmp_path)).first()
    assert (row["newly_enriched"], row["retried"], row["rejected"], row["input_tokens"], row["output_tokens"]) == (39, 3, 1, 7 * 42, 0)
    done, rejected = spark.read.parquet(f"{tmp_path}/notes"), spark.read.parquet(f"{tmp_path}/rejects")
    assert [r["task_id"] for r in rejected.collect()] == ["t03"]
    assert enrichment.pending(every, done, rejected).count() == 0
    row = enrichment.run(every, done, rejected, model, str(tmp_path)).first()
    assert (row["already_done"], row["newly_enriched"], row["rejected"]) == (39, 0, 0)
    with pytest.raises(enrichment.TooManyRejects):
        enrichment.run(every.limit(4), none, none, model, f"{tmp_path}/x")
    enrichment.guard(5, 100)
    assert enrichment.run(every, none, none, model, f"{tmp_path}/y", sample=1).first()["newly_enriched"] == 1


def test_stream_enriches_each_task_once(spark, tmp_path):
    schema = "task_id string, prompt string"
    for k in range(2):
        rows = tasks(spark).select("task_id", "prompt").filter(F.col("prompt").rlike(r" (?:[05-9]|1\d)$") if k == 0 else F.col("task_id") <= "t25")
        rows.coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        incremental.enrich_stream(spark, f"{tmp_path}/in", schema, model, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    ids = [r["task_id"] for r in spark.read.parquet(f"{tmp_path}/out/notes").collect()]
    assert len(ids) == len(set(ids)) == 25 and spark.read.parquet(f"{tmp_path}/out/rejects").count() == 1


def test_splits_never_mix(spark, tmp_path):
    every = tasks(spark).withColumn("topic_bucket_ids", F.array(F.lit("x")))
    notes = every.filter("task_id <> 't05'").select("task_id", F.lit("{}").alias("study_note"))
    routed = export.route(every, notes, 0.2)
    row = export.write_export(routed, str(tmp_path), "Be brief.").first()
    assert row["eval"] == 4 and row["holdout"] == 0 and row["skipped_unenriched"] == 1 and row["train"] + row["valid"] == 35 and row["valid"] > 0
    pairs = spark.read.json(f"{tmp_path}/pairs")
    assert {r["task_id"] for r in pairs.collect()}.isdisjoint({r["task_id"] for r in spark.read.json(f"{tmp_path}/references").collect()})
    assert pairs.first()["messages"][0]["content"] == "Be brief."
    with pytest.raises(export.ExportError):
        export.write_export(export.route(every.filter("split = 'eval'"), notes), f"{tmp_path}/x", "")


def test_evaluation(spark):
    refs = tasks(spark, 4)
    answers = F.when(F.col("task_id") == "t00", json.dumps(NOTE)).when(F.col("task_id") == "t01", json.dumps(NOTE | {"title": ""})).otherwise("none")
    cached = spark.createDataFrame([("t03", json.dumps(NOTE | {"key_concepts": [], "important_features_or_tools": []}))], "task_id string, raw_output string")
    rows = evaluation.evaluate(refs, lambda _: answers, cached)
    got = {r["task_id"]: (r["json_valid"], r["schema_valid"], r["score"], r["ungrounded"]) for r in rows.collect()}
    assert got == {"t00": (True, True, 2 / 3, ["depth"]), "t01": (True, False, 2 / 3, ["depth"]), "t02": (False, False, None, None), "t03": (True, True, 1.0, [])}
    row = evaluation.metrics(rows).first()
    assert row["tasks"] == 4 and row["json_valid_rate"] == 0.75 and abs(row["mean_groundedness"] - 7 / 9) < 1e-9


# Discovery and sinks


def test_urls_are_normalised(spark):
    def normal(url):
        return one(spark, discovery.normalize_url(F.col("x"), ["docs.x.com", "www.docs.x.com"], "docs.x.com"), x=url)

    assert normal(" http://www.DOCS.x.com/aws/en/a/b/?q=1#f") == "https://docs.x.com/a/b" and normal("https://docs.x.com/en/") == "https://docs.x.com/"
    assert normal("https://docs.x.com/aws/de/a") == "https://docs.x.com/aws/de/a" and normal("ftp://docs.x.com/a") is None and normal("https://other.com/") is None


def test_artifacts(spark, tmp_path):
    entries = spark.createDataFrame([("p", 2, "B", "u2", None), ("p", 1, "A", "u1", 150)], "playlist_id string, pos int, title string, url string, duration int")
    assert sinks.playlist_index(entries, F.lit("List")).first()["text"] == "# List\n\n1. [A](u1) (3 min)\n2. [B](u2)"
    assert sinks.modelfile("base", "Be brief.", {"temperature": "0.2"}) == 'FROM base\nPARAMETER temperature 0.2\nSYSTEM """Be brief."""\n'
    spark.range(3).coalesce(1).write.json(f"{tmp_path}/r")
    got = {r["name"]: (r["exists"], r["lines"]) for r in sinks.artifact_report(spark, {"r": f"{tmp_path}/r", "gone": f"{tmp_path}/gone"}).collect()}
    assert got == {"r": (True, 3), "gone": (False, 0)}


def test_prompts_take_content_literally(spark):
    assert one(spark, pack.build_prompt("a {{CONTENT}} {{SCHEMA}}", F.col("x"), "{}"), x=r"$1 \2 {{SCHEMA}}") == r"a $1 \2 {{SCHEMA}} {}"


def test_packs_are_built_from_a_folder(spark, tmp_path, capsys):
    from quillspark import cli

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("Title\n\n" + "word " * 200)
    (tmp_path / "in/sub/a.md").write_text("# Head\n" + "word " * 30)
    assert cli.main(["build-pack", f"file://{tmp_path}/in", f"file://{tmp_path}/out", "--bucket", "x"]) == 0
    rows = {r["task_id"]: r for r in spark.read.json(f"{tmp_path}/out/study_note_tasks").collect()}
    assert len(rows) == 2 and rows["pack__a__c0000"]["chunk_word_count"] == 201
    assert {r["source_id"]: r["low_quality_chunk_count"] for r in spark.read.json(f"{tmp_path}/out/source_pack").collect()}["a"] == 0
    assert cli.main(["audit", f"{tmp_path}/out/study_note_tasks"]) == 1 and "1 of 2 tasks" in capsys.readouterr().out


def test_batches_are_resumed(spark, tmp_path):
    from quillspark.operators import batches

    every, sent = tasks(spark, 6), []

    def submit(rows):
        sent.append(rows.count())
        return f"b{len(sent)}"

    def collect(batch_id):
        good = F.when(F.col("request_key") < "8", "succeeded").otherwise("expired")
        return batches.requests(every).select("request_key", good.alias("kind"), F.lit(batch_id).alias("text"), F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"))

    for _ in range(2):  # the second run finds the first one's batch
        got = batches.run_batch(every, submit, collect, f"{tmp_path}/state").collect()
        assert len(got) == 6 and all((r["answer"]["text"] == "b1") != (r["answer"]["error"] == "batch result: expired") for r in got)
    batches.run_batch(every.limit(3), submit, collect, f"{tmp_path}/state").collect()
    assert sent == [6, 3] and batches.in_flight(spark, f"{tmp_path}/state").count() == 3
    batches.finish(spark, f"{tmp_path}/state")
    assert batches.in_flight(spark, f"{tmp_path}/state") is None


def test_smoke_sets_are_backfilled(spark):
    pairs = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "valid")], "task_id string, bucket string")
    assert sorted(map(tuple, export.backfilled(pairs).collect())) == [("a", "test"), ("a", "train"), ("b", "test"), ("b", "train"), ("c", "valid")]
    with pytest.raises(export.ExportError):
        export.backfilled(pairs.filter("bucket = 'valid'"))


def test_written_tables_are_cleared(spark):
    from quillspark import storage

    before = list(storage._written)
    storage._written.clear()
    df = storage.materialise(spark.range(3), "x")
    assert df.count() == 3
    storage.clear(spark)
    assert not storage._written
    storage._written.extend(before)


# Rules as a table, sitemaps of sitemaps


def test_rules_as_a_table_fit_like_rules_as_literals(spark):
    import random

    rng = random.Random(4)
    names = ["a", "ab", "b", "c/", "A", "", "d//", "e.f"]
    made = lambda n: "/" + "/".join(rng.choice(names) for _ in range(rng.randint(0, n)))
    rules = {f"r{i}": [made(3) for _ in range(rng.randint(1, 3))] for i in range(60)}
    rules["odd"] = ["", "b", "/zz/", "/zz"]
    rules["none"] = ["/never/"]
    paths = [(i, made(5)) for i in range(300)] + [(900, None), (901, ""), (902, "b/x"), (903, "/zz"), (904, "/never"), (905, "/neverx")]
    rows = spark.createDataFrame(paths, "id int, p string")
    table = spark.createDataFrame([(i, b, p) for i, (b, ps) in enumerate(rules.items()) for p in ps] + [(99, "null", None)], "ord int, bucket string, prefix string")
    want = {r["id"]: r["b"] for r in rows.select("id", F.coalesce(discovery.topic_buckets(F.col("p"), rules), F.array().cast("array<string>")).alias("b")).collect()}
    for most in (200_000, 0):
        got = {r["id"]: r["buckets"] for r in discovery.match_prefix_rules(rows, F.col("p"), table, broadcast_rows=most).collect()}
        assert got == want
    assert {"odd", "none"} <= set(want[904]) and "none" not in want[905]


def test_ten_thousand_rules(spark):
    rules = spark.range(10_000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("b"), F.col("id") % 100).alias("bucket"), F.concat(F.lit("/s"), F.col("id"), F.lit("/")).alias("prefix"))
    rows = spark.range(20_000).select("id", F.concat(F.lit("/s"), F.col("id"), F.lit("/x")).alias("p"))
    found = discovery.match_prefix_rules(rows, F.col("p"), rules)
    assert found.filter(F.size("buckets") == 1).count() == 10_000 and found.filter((F.size("buckets") == 1) & (F.col("buckets")[0] == F.concat(F.lit("b"), F.col("id") % 100))).count() == 10_000
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_an_index_of_sitemaps_gives_their_union(spark, tmp_path):
    page = "<url><loc> https://x/{} </loc><priority>1</priority></url>"
    (tmp_path / "one.xml").write_text('<?xml version="1.0"?><urlset xmlns="u">' + page.format("a") + page.format("b&amp;c") + "<url><loc></loc></url></urlset>")
    (tmp_path / "two.xml").write_text('<s:urlset xmlns:s="u"><s:url><s:loc>https://x/d</s:loc></s:url>' + page.format("a") + "</s:urlset>")
    (tmp_path / "index.xml").write_text("<sitemapindex>" + "".join(f"<sitemap><loc>https://x/{n}.xml</loc></sitemap>" for n in ("one", "two", "index", "gone")) + "</sitemapindex>")
    local = lambda at: F.when(~at.contains("gone"), F.replace(at, F.lit("https://x/"), F.lit(f"file://{tmp_path}/")))
    got = [r["loc"] for r in discovery.read_sitemaps(spark, [f"file://{tmp_path}/index.xml"], local).collect()]
    assert sorted(got) == ["https://x/a", "https://x/b&c", "https://x/d"]
    assert discovery.read_sitemaps(spark, [f"file://{tmp_path}/one.xml"]).count() == 2


def test_sessions_of_a_hot_key_are_counted_across_ranges(spark):
    import random

    rng = random.Random(6)
    rows = []
    for user, n in (("hot", 3000), ("b", 40), (None, 60), ("one", 1)):
        at = 0
        for k in range(n):
            at += rng.choice([1, 2, 30])
            rows.append((user, k, at))
    rng.shuffle(rows)
    want, last = {}, {}
    for user, k, at in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        session = last[user][1] + (at - last[user][0] > 10) if user in last else 0
        want[user, k] = session
        last[user] = (at, session)
    df = spark.createDataFrame(rows, "user string, k int, at int").repartition(5)
    got = transcript.gap_sessions(df, "user", ["k"], F.col("at"), F.col("at"), 10.0)
    assert {(r["user"], r["k"]): r["session"] for r in got.collect()} == want and got.columns == ["user", "k", "at", "session"]


def test_files_that_share_a_name_get_ids_without_a_task_for_them_all(spark):
    paths = [f"{i % 50}/{i}/readme.md" for i in range(2000)] + ["readme.md", "a/other.md"]
    rows = manifest.folder_sources(spark.createDataFrame([(p,) for p in paths], "path string"), ["x"])
    got = {r["local_path"]: r for r in rows.collect()}
    assert len({r["source_id"] for r in got.values()}) == 2002
    first = min(paths[:-1], key=lambda p: p.split("/"))
    assert got[first]["source_id"] == "readme" and got["a/other.md"]["source_id"] == "other"
    assert sorted(r["priority"] for r in got.values()) == list(range(1, 2003))
