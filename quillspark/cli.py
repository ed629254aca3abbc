"""Command line: python -m quillspark.cli COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillspark import storage
from quillspark.functions import html
from quillspark.functions import text as T
from quillspark.operators import answers, chunking, discovery, enrichment, evaluation, export, pack, selection, sinks, transcript, validation
from quillspark.session import get_session
from quillspark.sources import files, jsonl, manifest


def build_pack(args: argparse.Namespace) -> int:
    """Tasks of all files in a folder, with an index."""
    spark = get_session("build-pack")
    paths, unsupported = files.scan(spark, args.folder, not args.flat)
    if paths.isEmpty():
        print(f"no supported files in {args.folder} ({unsupported} others)")
        return 1
    sources = manifest.folder_sources(paths.select("path"), args.bucket, args.split)
    docs = files.read_documents(spark, args.folder, paths)
    joined = docs.withColumnRenamed("path", "local_path").drop("title").join(sources, "local_path")
    chunks = chunking.chunk_documents(joined)
    tasks = pack.tasks(chunks, args.pack_id, args.template, "{}")
    sections = joined.select("source_id", F.explode("sections").alias("s")).select("source_id", T.word_count(F.col("s.text")).alias("word_count"))
    index = pack.index_sources(sources.withColumn("skipped", F.lit(False)), sections, chunks)
    for path in sinks.write_pack(sources, joined, tasks, index, args.out):
        print(path)
    return 0


def audit(args: argparse.Namespace) -> int:
    """Small tasks of a pack, by source."""
    spark = get_session("audit")
    tasks = spark.read.json(args.tasks)
    small = pack.audit(tasks, args.least)
    total = small.agg(F.coalesce(F.sum("flagged"), F.lit(0))).first()[0]
    print(f"{total} of {tasks.count()} tasks have fewer than {args.least} words")
    shown(small)
    pack.audit_preview(tasks, args.least).show(20, truncate=False)
    return int(total > 0)


def export_pairs(args: argparse.Namespace) -> int:
    """Training pairs and references of tasks and notes."""
    spark = get_session("export")
    routed = export.route(spark.read.json(args.tasks), spark.read.parquet(args.notes), args.valid_fraction)
    export.write_export(routed, args.out, args.system_prompt).show()
    return 0


def service(name: str):
    """A function given as package.module:function."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def discover(args: argparse.Namespace) -> int:
    """New sources of link indexes or sitemaps, in the buckets of a rules file, added to a manifest."""
    spark = get_session("discover")
    with open(args.rules, encoding="utf-8") as file:
        rules = json.load(file)  # hosts, home, buckets, excluded
    texts = spark.read.text(args.index, wholetext=True)
    index = F.explode(discovery.parse_link_index(F.col("value")))
    found = texts.select(index.alias("l")).select("l.*") if not args.sitemap else texts.select(F.explode(discovery.parse_sitemap(F.col("value"))).alias("url")).select(F.col("url").alias("title"), "url", F.lit("").alias("description"))
    links = found.withColumn("url", discovery.normalize_url(F.col("url"), rules["hosts"], rules["home"])).filter("url is not null")
    links = links.withColumns({"group": F.lit(0), "ord": F.monotonically_increasing_id()})
    every = discovery.candidates(links, rules["buckets"], rules.get("excluded", []), args.folder, "sitemap" if args.sitemap else "index", "About ")
    own = manifest.read_manifest(spark, args.manifest)
    known = own.select(F.explode("sources").alias("s")).select("s.original_url", "s.source_id")
    fresh = selection.first(discovery.new_candidates(discovery.merge_candidates(every), known), args.limit, "group", "ord")
    rows = storage.materialise(discovery.apply_candidates(fresh, args.first_priority), "new-sources")
    shown(rows.select("source_id", "original_url", "priority"))
    if args.out:
        manifest.write_manifest(manifest.append_sources(own, rows), args.out)
    return 0


def shown(rows, most: int = 1000) -> None:
    """Print rows, and how many there are if that is more."""
    total = rows.count()
    rows.show(most, truncate=False)
    if total > most:
        print(f"the first {most} of {total} rows")


def enrich(args: argparse.Namespace) -> int:
    """Notes for the tasks that have none, by a model given as package.module:function."""
    spark = get_session("enrich")
    tasks = jsonl.read_jsonl(spark, args.tasks, jsonl.TASK)
    before = lambda name: storage.committed(spark, args.out, name, "task_id string")
    store = answers.AnswerStore(spark, f"{args.out}/answers")
    try:
        enrichment.run(tasks, before("notes"), before("rejects"), service(args.model), args.out, args.sample, args.most_rejects, store, args.model).show(truncate=False)
    except enrichment.TooManyRejects as error:
        print(error)
        return 1
    return 0


def evaluate(args: argparse.Namespace) -> int:
    """Metrics of a model, given as package.module:function, over references; answers are kept for the next run."""
    spark = get_session("evaluate")
    references = selection.first(jsonl.read_jsonl(spark, args.references, jsonl.REFERENCE), args.limit, "task_id")
    store = answers.AnswerStore(spark, f"{args.out}/answers")
    rows = evaluation.evaluate(references, service(args.model), model=args.name, store=store)
    if args.judge:
        rows = evaluation.judge(rows, service(args.judge), judge_name=args.judge, store=store)
    rows.select("task_id", "raw_output", *[c for c in ("judge_error", *validation.RUBRIC) if c in rows.columns]).write.mode("overwrite").parquet(f"{args.out}/outputs/model={args.name}")
    row = evaluation.metrics(rows)
    evaluation.write_metrics(row, f"{args.out}/metrics-{args.name}")
    evaluation.rounded(row).show(truncate=False)
    return 0


def compare(args: argparse.Namespace) -> int:
    """Metrics of several runs side by side."""
    spark = get_session("compare")
    runs = [spark.read.json(path).withColumn("model", F.lit(name)) for name, path in (run.split("=", 1) for run in args.runs)]
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run, allowMissingColumns=True)
    keys = [c for c in every.columns if c != "model"]
    evaluation.compare(every, [run.split("=", 1)[0] for run in args.runs], keys).show(100, truncate=False)
    return 0


def fetch(args: argparse.Namespace) -> int:
    """Fetched pages (source_id, title, url, html) as Markdown files, thin ones and those that are there left out."""
    spark = get_session("fetch")
    pages = selection.only(spark.read.parquet(args.pages), "source_id", args.only)
    try:
        there = spark.read.parquet(args.out).select(F.col("source_id").alias("path"))
    except AnalysisException:
        there = spark.createDataFrame([], "path string")
    todo = selection.missing_files(pages, "source_id", there, args.force)
    made = todo.filter(~html.is_thin_page(F.col("html"))).select("source_id", html.page_document(F.col("title"), F.col("url"), F.col("html")).alias("markdown"))
    made = storage.materialise(made, "fetched")
    made.write.mode("overwrite" if args.force else "append").parquet(args.out)
    print(f"{made.count()} pages written")
    return 0


def transcripts(args: argparse.Namespace) -> int:
    """Caption files of a folder as texts of merged paragraphs."""
    spark = get_session("transcripts")
    paths = files.list_tree(spark, args.folder).filter(files.reader_of(F.col("path")) == "captions")
    if paths.isEmpty():
        print(f"no captions in {args.folder}")
        return 1
    docs = files.read_documents(spark, args.folder, paths)
    merged = transcript.merge_transcript(F.col("sections"), args.most_words, args.most_seconds, args.most_gap)
    docs.select("path", sinks.transcript_text(merged).alias("text")).write.mode("overwrite").parquet(args.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    commands = parser.add_subparsers(required=True)
    own = commands.add_parser("build-pack", help=build_pack.__doc__)
    own.add_argument("folder")
    own.add_argument("out")
    own.add_argument("--pack-id", default="pack")
    own.add_argument("--bucket", action="append", default=[])
    own.add_argument("--split", default="unassigned")
    own.add_argument("--template", default="{{CONTENT}}")
    own.add_argument("--flat", action="store_true")
    own.set_defaults(run=build_pack)
    own = commands.add_parser("audit", help=audit.__doc__)
    own.add_argument("tasks")
    own.add_argument("--least", type=int, default=120)
    own.set_defaults(run=audit)
    own = commands.add_parser("export", help=export_pairs.__doc__)
    own.add_argument("tasks")
    own.add_argument("notes")
    own.add_argument("out")
    own.add_argument("--system-prompt", default=export.SYSTEM_PROMPT)
    own.add_argument("--valid-fraction", type=float, default=0.05)
    own.set_defaults(run=export_pairs)
    own = commands.add_parser("discover", help=discover.__doc__)
    own.add_argument("index")
    own.add_argument("manifest")
    own.add_argument("rules")
    own.add_argument("--out")
    own.add_argument("--sitemap", action="store_true")
    own.add_argument("--folder", default="docs")
    own.add_argument("--limit", type=int)
    own.add_argument("--first-priority", type=int, default=100)
    own.set_defaults(run=discover)
    own = commands.add_parser("enrich", help=enrich.__doc__)
    own.add_argument("tasks")
    own.add_argument("out")
    own.add_argument("model")
    own.add_argument("--sample", type=int)
    own.add_argument("--most-rejects", type=float, default=0.05)
    own.set_defaults(run=enrich)
    own = commands.add_parser("evaluate", help=evaluate.__doc__)
    own.add_argument("references")
    own.add_argument("out")
    own.add_argument("model")
    own.add_argument("--name", default="model")
    own.add_argument("--judge")
    own.add_argument("--limit", type=int)
    own.set_defaults(run=evaluate)
    own = commands.add_parser("compare", help=compare.__doc__)
    own.add_argument("runs", nargs="+", metavar="NAME=PATH")
    own.set_defaults(run=compare)
    own = commands.add_parser("fetch", help=fetch.__doc__)
    own.add_argument("pages")
    own.add_argument("out")
    own.add_argument("--only", action="append")
    own.add_argument("--force", action="store_true")
    own.set_defaults(run=fetch)
    own = commands.add_parser("transcripts", help=transcripts.__doc__)
    own.add_argument("folder")
    own.add_argument("out")
    own.add_argument("--most-words", type=int, default=120)
    own.add_argument("--most-seconds", type=float, default=90.0)
    own.add_argument("--most-gap", type=float, default=8.0)
    own.set_defaults(run=transcripts)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    raise SystemExit(main())
