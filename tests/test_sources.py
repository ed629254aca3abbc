"""Readers, selection, sizes, judges and the command line by small examples."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark import cli, storage
from quillspark.functions import html
from quillspark.functions import names as N
from quillspark.operators import discovery, evaluation, selection, transcript
from quillspark.order import ordinal
from quillspark.sources import files, manifest, pdf, speech


def made_pdf(pages: list[bytes], packed: bool, maps: bytes = b"") -> bytes:
    out = [b"%PDF-1.4", b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj"]
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    out.append(b"2 0 obj <</Type /Pages /Kids [" + kids + b"]>> endobj")
    out.append(b"5 0 obj <</Type /Font /ToUnicode 6 0 R>> endobj\n6 0 obj <<>>\nstream\n" + maps + b"\nendstream endobj")
    for i, page in enumerate(pages):
        raw = zlib.compress(page) if packed else page
        out.append(b"%d 0 obj <</Type /Page /Contents %d 0 R /Resources <</Font <</F1 5 0 R>>>>>> endobj" % (10 + 2 * i, 11 + 2 * i))
        out.append(b"%d 0 obj <<%s>>\nstream\n" % (11 + 2 * i, b"/Filter /FlateDecode" if packed else b"") + raw + b"\nendstream\nendobj")
    return b"\n".join(out)


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_pages_are_read_in_order(packed):
    pages = [
        rb"BT /F0 12 Tf 50 700 Td (Hello \(big\) w\157rld) Tj 0 -14 Td [(Sec) 20 (ond) -300 (line)] TJ ET",
        rb"BT /F0 9 Tf 0 0 Td (-- .. ;;) Tj ET",
        rb"BT /F1 9 Tf 14 TL 0 100 Td <00410042> Tj T* <0043> Tj ET",
    ]
    maps = b"1 beginbfchar <0041> <0058> endbfchar 1 beginbfrange <0042> <0043> <0079> endbfrange"
    got = pdf.sections(made_pdf(pages, packed, maps))
    assert [(s["index"], s["page_number"], s["text"]) for s in got] == [(0, 1, "Hello (big) world\nSecond line"), (1, 3, "Xy\nz")]
    seen = pdf.sections(made_pdf(pages, packed, maps), lambda content, numbers: {n: f"seen {n}" for n in numbers})
    assert [(s["page_number"], s["text"], s["extraction_method"]) for s in seen][1] == (2, "seen 2", "classic+ocr")
    with pytest.raises(pdf.NothingToRead):
        pdf.sections(made_pdf([pages[1]], packed))


def test_thin_pages_are_read_by_place():
    rows = b" ".join(rb"1 0 0 1 %d %d Tm (w%d) Tj" % (x * 30, 700 - y * 10, y * 9 + x) for x in range(9) for y in range(9))
    content = made_pdf([b"BT " + rows + b" ET"], True)
    thin = pdf.sections(content, extract=lambda shown: "only this")
    assert thin[0]["extraction_method"] == "layout" and thin[0]["text"].split() == [f"w{i}" for i in range(81)]


def test_pdf_files_have_a_reader(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made_pdf([b"BT (Some text here) Tj ET"], True))
    with pytest.raises(ValueError, match="sources.speech"):
        files.route("x.mp3")
    files.register(".pdf", READ_PDF)
    files.register(".pdf", READ_PDF)
    got = files.read_documents(spark, f"file://{tmp_path}", ["a.pdf"]).first()
    assert got["sections"][0]["text"] == "Some text here" and got["sections"][0]["page_number"] == 1


READ_PDF = pdf.reader()


def test_speech_becomes_sections(tmp_path):
    heard = [{"text": " hello  there ", "start": 0.004, "end": 1.236, "confidence": 0.5}, {"text": " "}, {"text": "there you are", "start": 1.5, "end": 2}, {"text": "later", "start": 60, "end": 61}]
    assert [(s["index"], s["text"], s["start_time_s"], s["end_time_s"]) for s in speech.sections(heard)] == [(0, "hello there", 0.0, 1.24), (1, "there you are", 1.5, 2.0), (2, "later", 60.0, 61.0)]
    assert [s["text"] for s in speech.sections(heard, merge=True)] == ["hello there you are", "later"]
    paths = []
    read = speech.reader(lambda path: paths.append(path) or heard)
    assert len(list(read("x/talk.mp3", b"abc"))) == 3 and paths[0].endswith(".mp3")


def test_pages_become_markdown(spark):
    page = "<html><head><title>T</title></head><body><h2 class=a>Head</h2><p>One <b>two</b> <a href=\"u\">three</a></p><ul><li>x<li>y</ul><pre>code</pre></body></html>"
    df = spark.createDataFrame([(page, "t", "http://u")], "html string, title string, url string")
    got = df.select(html.markdown(F.col("html")).alias("m"), html.page_document(F.col("title"), F.col("url"), F.col("html")).alias("d"), html.is_thin_page(F.col("html")).alias("thin")).first()
    assert got["m"] == "## Head\n\nOne **two** [three](u)\n\n- x\n- y\n\n```\ncode\n```" and got["d"].startswith("# t\n\nSource: http://u\n\n## Head") and got["thin"]


def test_links_are_read_line_by_line(spark):
    text = "# I\n- [a](https://x/a)\n- [b](https://x/b) - about b\n  - [c d](http://x/c): no\n- no link\n-[e](https://x/e)-e\n- [f](ftp://x)\ntext [g](https://x/g)\n- [h](https://x/h)\n- plain line\n- [i](https://x/i)"
    got = spark.createDataFrame([(text,)], "t string").select(discovery.parse_link_index(F.col("t"))).first()[0]
    assert [(r["title"], r["url"], r["description"]) for r in got] == [("a", "https://x/a", ""), ("b", "https://x/b", "about b"), ("e", "https://x/e", "e"), ("h", "https://x/h", "plain line"), ("i", "https://x/i", "")]


def test_figures_of_logs(spark):
    log = "x\nIter 10: Train loss 2.5, it/sec 1\nIter 10: Val loss 3.5, Val took 1s\nIter  20: Train loss 1.25\nPeak mem 8.5 GB\nIter x: Train loss y"
    got = spark.createDataFrame([(log.rpartition("\n")[0],), ("",)], "t string").select(N.training_figures(F.col("t")).alias("v")).select("v.*").collect()
    assert tuple(got[0]) == (8.5, 20, 1.25, 10, 3.5) and tuple(got[1]) == (None,) * 5


def test_seams_are_found():
    assert transcript.seam("we go Home, now".split(), "home now then".split()) == 2
    assert transcript.seam(["a", "b", "a"], ["a", "b", "a", "c"]) == 3 and transcript.seam([], ["a"]) == 0 and transcript.seam(["x"], ["y"]) == 0


def test_rows_are_selected(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "k string, n int")
    ids = lambda df: sorted(r["k"] for r in df.collect())
    assert ids(selection.only(rows, "k", ["a", "z"])) == ["a"] and ids(selection.only(rows, "k", None)) == ["a", "b", "c"]
    assert ids(selection.selected_or_all(rows, "k", rows.filter("k = 'b'"))) == ["b"] and ids(selection.selected_or_all(rows, "k", rows.select(F.lit("q").alias("k")))) == ["a", "b", "c"]
    listing = spark.createDataFrame([("a", 5), ("b.part", 5), ("c", 0)], "path string, length int")
    assert ids(selection.missing_files(rows, "k", listing)) == ["b", "c"] and ids(selection.missing_files(rows, "k", listing, force=True)) == ["a", "b", "c"]
    assert [r["k"] for r in selection.first(rows, 2, "n").collect()] == ["b", "c"]
    with pytest.raises(ValueError):
        selection.first(rows, -1, "n")


def test_places_are_global(spark):
    rows = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 1000)
    got = ordinal(rows.repartition(7), [F.col("v")], "at").collect()
    assert all(r["at"] == r["v"] for r in got)


def test_judges_may_fail(spark):
    rows = spark.createDataFrame([(i, "src", "{}", i != 4) for i in range(5)], "task_id long, source_content string, raw_output string, json_valid boolean")
    said = F.when(F.col("task_id") == 0, '{"groundedness":4,"completeness":3,"schema_quality":5}').when(F.col("task_id") == 1, '{"groundedness":0,"completeness":3,"schema_quality":5}').when(F.col("task_id") == 2, "no")
    ask = lambda _: F.struct(said.alias("text"), F.when(F.col("task_id") == 3, "timeout").alias("error"))
    judged = evaluation.judge(rows, ask)
    got = {r["task_id"]: (r["groundedness"], r["judge_error"]) for r in judged.collect()}
    assert got[0] == (4, None) and got[3] == (None, "timeout") and got[4] == (None, None) and got[1][0] is None and got[1][1] and got[2][1]
    cached = judged.filter("task_id = 0").select("task_id", F.lit("j").alias("judge_name"), "raw_output", "answer")
    never = lambda _: F.struct(F.lit(None).cast("string").alias("text"), F.lit("asked again").alias("error"))
    again = {r["task_id"]: r["judge_error"] for r in evaluation.judge(rows, never, cached, "j").collect()}
    assert again == {0: None, 1: "asked again", 2: "asked again", 3: "asked again", 4: None}


MANIFEST = {"manifest_version": "1.0", "pack_id": "p", "title": "T", "domain": "d", "topic_buckets": [{"id": "x", "label": "X"}], "sources": [{"source_id": "doc_a", "title": "A", "resource_type": "article", "original_url": "https://h.com/a", "local_path": "a.md", "topic_bucket_ids": ["x"]}]}


def test_discovery_appends_to_a_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MANIFEST))
    (tmp_path / "rules.json").write_text(json.dumps({"hosts": ["h.com"], "home": "h.com", "buckets": {"x": ["/"]}, "excluded": ["/no"]}))
    (tmp_path / "index.txt").write_text("- [A](https://h.com/a)\n- [B](https://h.com/b) - about b\n- [N](https://h.com/no/x)\n- [C](https://h.com/c)\n")
    assert cli.main(["discover", str(tmp_path / "index.txt"), str(tmp_path / "m.json"), str(tmp_path / "rules.json"), "--out", str(tmp_path / "out"), "--limit", "1"]) == 0
    rows = manifest.read_manifest(spark, str(tmp_path / "out")).select(F.explode("sources").alias("s")).select("s.source_id", "s.original_url").collect()
    assert [tuple(r) for r in rows] == [("doc_a", "https://h.com/a"), ("doc_b", "https://h.com/b")]


def answer(_):
    return F.lit('{"title":"t","summary":"s","key_concepts":[],"important_features_or_tools":[],"practical_workflow":[],"common_mistakes_or_confusions":[],"project_usage_notes":[]}')


def model(prompt):
    return F.struct(answer(prompt).alias("text"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"))


def judge(_):
    return F.struct(F.lit('{"groundedness":4,"completeness":3,"schema_quality":5}').alias("text"), F.lit(None).cast("string").alias("error"))


def test_command_line_runs_models(spark, tmp_path, capsys):
    rows = [{"task_id": f"t{i}", "split": "train", "source_id": "s", "prompt": "p", "source_content": "c"} for i in range(4)]
    (tmp_path / "tasks.json").write_text("\n".join(map(json.dumps, rows)))
    for _ in range(2):
        assert cli.main(["enrich", str(tmp_path / "tasks.json"), str(tmp_path / "out"), f"{__name__}:model"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out/notes").count() == 4
    for name in ("m1", "m1", "m2"):
        assert cli.main(["evaluate", str(tmp_path / "tasks.json"), str(tmp_path / "eval"), f"{__name__}:answer", "--name", name, "--judge", f"{__name__}:judge", "--limit", "3"]) == 0
    assert spark.read.parquet(f"{tmp_path}/eval/outputs").count() == 6
    assert spark.read.json(f"{tmp_path}/eval/metrics-m1").first()["judge_groundedness"] == 4.0
    assert cli.main(["compare", f"m1={tmp_path}/eval/metrics-m1", f"m2={tmp_path}/eval/metrics-m2"]) == 0 and "mean_groundedness" in capsys.readouterr().out


def test_command_line_fetches_and_transcribes(spark, tmp_path, capsys):
    pages = [("a", "A", "u", "<p>" + "word " * 100 + "</p>"), ("b", "B", "u", "<p>few</p>")]
    spark.createDataFrame(pages, "source_id string, title string, url string, html string").write.parquet(f"{tmp_path}/pages")
    for _ in range(2):
        assert cli.main(["fetch", f"{tmp_path}/pages", f"{tmp_path}/md"]) == 0
    assert "1 pages written\n0 pages written" in capsys.readouterr().out and spark.read.parquet(f"{tmp_path}/md").count() == 1
    (tmp_path / "v").mkdir()
    (tmp_path / "v/x.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nhello there\n\n00:03.000 --> 00:04.000\nthere you are\n")
    assert cli.main(["transcripts", f"file://{tmp_path}/v", f"{tmp_path}/t"]) == 0
    assert spark.read.parquet(f"{tmp_path}/t").first()["text"] == "hello there you are"
    (tmp_path / "w").mkdir()
    assert cli.main(["transcripts", f"file://{tmp_path}/w", f"{tmp_path}/t2"]) == 1


@pytest.mark.parametrize("uri, own", [("s3a://b/x", "s3://b/x"), ("s3n://b", "s3://b"), ("s3://b/x", "s3://b/x"), ("file:/tmp/x", "file:///tmp/x"), ("file:///tmp/x", "file:///tmp/x"), ("hdfs://h:1/x", "hdfs://h:1/x"), ("gs://b/s3a:x", "gs://b/s3a:x")])
def test_paths_of_hadoop_as_arrow_names_them(uri, own):
    assert storage.arrow_uri(uri) == own


def test_lines_keep_their_order_without_a_column_for_it(spark, tmp_path):
    """Files of many blocks, read by many tasks, with blank lines between."""
    from quillspark.sources import jsonl

    want = []
    for name, n in (("b.json", 4000), ("a.json", 3000), ("c.json", 10)):
        ids = [f"{name[0]}{(k * 7919) % n}" for k in range(n)]
        (tmp_path / name).write_text("\n\n".join(json.dumps({"task_id": i, "other": 1}) for i in ids) + "\n")
        want += [(name, ids)]
    ordered = [i for _, ids in sorted(want) for i in ids]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = jsonl.read_jsonl(spark, str(tmp_path), "task_id string")
        assert rows.rdd.getNumPartitions() > 5
        assert [r["task_id"] for r in selection.first(rows, 3500, "ord").collect()] == ordered[:3500]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_broken_line_is_an_error(spark, tmp_path):
    from quillspark.sources import jsonl

    (tmp_path / "x.json").write_text('{"task_id": "a"}\n{"task_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_jsonl(spark, str(tmp_path), "task_id string").collect()
