"""The query catalogue: name, function of (spark, sf_dir), and SQL for an independent check.

Where an operator's input isn't among the tables, it is made from them by
expressions that both engines evaluate alike.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import html as H
from quillspark.functions import names as N
from quillspark.functions import text as T
from quillspark import storage
from quillspark.operators import batches, chunking, discovery, enrichment, evaluation, export, pack, selection, sinks, transcript, validation
from quillspark.plans import duck as D
from quillspark.session import small_batches, table
from quillspark.sources import documents as DOC
from quillspark.sources import files, jsonl, pdf, speech
from quillspark.sources import manifest as M
from quillspark.sources import sections as S

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    """Add a function to the catalogue under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


# Text functions


@query(f"SELECT doc_id, {D.word_count('text')}::INT AS n_words, length(text)::INT AS n_chars, len({D.sentences('text')})::INT AS n_sentences FROM documents")
def word_stats(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", T.word_count(t).alias("n_words"), F.length(t).alias("n_chars"), F.size(T.sentences(t)).alias("n_sentences"))


RAGGED = "replace(replace(text, '. ', '.  \t' || chr(13) || chr(10) || chr(10) || ' ' || chr(10) || chr(10)), ', ', ' ,\t ')"


def ragged() -> F.Column:
    """Text with tabs, carriage returns and runs of blank lines."""
    return F.replace(F.replace("text", F.lit(". "), F.lit(".  \t\r\n\n \n\n")), F.lit(", "), F.lit(" ,\t "))


@query(f"SELECT doc_id, sha256(c) AS text_sha256, length(c)::INT AS n_chars FROM (SELECT doc_id, {D.clean_text(RAGGED)} AS c FROM documents)")
def clean_text(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.clean_text(ragged()).alias("c"))
    return rows.select("doc_id", F.sha2("c", 256).alias("text_sha256"), F.length("c").alias("n_chars"))


@query(f"""
WITH f AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {D.strip('x')}), lambda x: x <> '')[1] AS first FROM documents)
SELECT doc_id, CASE WHEN first IS NOT NULL AND {D.word_count('first')} <= 15 THEN first ELSE 'doc ' || doc_id END AS title FROM f""")
def detect_title(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.text_title(F.col("text"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("title"))


@query(rf"""
WITH s AS (SELECT doc_id, {D.strip("CASE WHEN doc_id % 7 = 0 THEN regexp_replace(text, '[a-m]', '%', 'g') WHEN doc_id % 11 = 0 THEN replace(text, 'e', chr(65533)) ELSE text END")} AS t FROM documents),
c AS (SELECT doc_id, length(t) AS n, len(regexp_extract_all(t, '[^{D.SPACE}]')) AS solid, len(regexp_extract_all(t, '[\pL\pN]')) AS alnum, length(t) - length(replace(t, chr(65533), '')) AS replaced,
       len(regexp_extract_all(regexp_replace(t, '[{D.SPACE}]', '', 'g'), '\pC')) AS hidden FROM s)
SELECT doc_id, n = 0 OR (n - hidden) * 10 < n * 9 OR replaced * 20 > n OR alnum * 2 < solid AS garbage FROM c""")
def garbage_text(spark, sf_dir):
    noisy = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("text", "[a-m]", "%")).when(F.col("doc_id") % 11 == 0, F.replace("text", F.lit("e"), F.lit("�"))).otherwise(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", T.is_garbage(noisy).alias("garbage"))


@query(f"SELECT doc_id, n >= 40 AND e * 2 < n AND e < 40 AS retry FROM (SELECT doc_id, {D.word_count('text')} AS n, {D.word_count('left(text, 40 + (doc_id % 9)::INT * 30)')} AS e FROM documents)")
def thin_extraction(spark, sf_dir):
    some = F.expr("left(text, 40 + cast(doc_id % 9 as int) * 30)")
    return documents(spark, sf_dir).select("doc_id", T.is_thin_extraction(some, F.col("text")).alias("retry"))


@query(f"SELECT doc_id, {D.slug('text', 60, 'index')} AS slug60, {D.slug('text', 40, 'video')} AS slug40 FROM documents")
def slug(spark, sf_dir):
    own = F.col("text")
    return documents(spark, sf_dir).select("doc_id", T.slug(own, "index", 60).alias("slug60"), T.slug(own, "video", 40).alias("slug40"))


@query("SELECT doc_id, substr(sha256('pack__' || source || '__' || doc_id), 1, 32) AS request_key FROM documents")
def request_key(spark, sf_dir):
    rows = documents(spark, sf_dir, "doc_id", "source")
    return rows.select("doc_id", T.request_key(F.concat(F.lit("pack__"), "source", F.lit("__"), F.col("doc_id").cast("string"))).alias("request_key"))


@query("""
SELECT page_id, CASE regexp_extract(lower(url), '(\\.[a-z0-9]+)(?:[?#].*)?$', 1) WHEN '.pptx' THEN 'tutorial' WHEN '.txt' THEN 'article' WHEN '.text' THEN 'article'
       WHEN '.mp4' THEN 'video_transcript' ELSE 'documentation' END AS resource_type FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '.MP4' WHEN 1 THEN url || '.txt' WHEN 2 THEN url || '.pptx' ELSE url END AS url FROM pages)""")
def infer_type(spark, sf_dir):
    own = F.expr("CASE page_id % 5 WHEN 0 THEN url || '.MP4' WHEN 1 THEN url || '.txt' WHEN 2 THEN url || '.pptx' ELSE url END")
    rows = table(spark, sf_dir, "pages").select("page_id", own.alias("url"))
    return rows.select("page_id", T.resource_type(F.regexp_extract(F.lower("url"), r"(\.[a-z0-9]+)(?:[?#].*)?$", 1)).alias("resource_type"))


TAGS = ["en", "DE-at", "fr", "es-MX", "it", "pt-BR", "nl", "ru", "zh-Hans", "JA", "ko", "xx", ""]
CODES = ["eng", "deu", "fra", "spa", "ita", "por", "nld", "rus", "chi_sim", "jpn", "kor", "eng", "eng"]


@query(f"SELECT doc_id, {CODES}[(doc_id % {len(CODES)})::INT + 1] AS code FROM documents")
def lang_code(spark, sf_dir):
    tag = F.get(F.array(*map(F.lit, TAGS)), (F.col("doc_id") % len(TAGS)).cast("int"))
    return documents(spark, sf_dir, "doc_id").select("doc_id", T.recognition_language(tag).alias("code"))


@query(f"""
WITH p AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
q AS (SELECT doc_id, array_to_string(w[1:len(w) // 2], ' ') AS a, array_to_string(w[greatest(1, len(w) // 2 + 1 - (doc_id % 45)::INT):], ' ') AS b FROM p)
SELECT doc_id, {D.overlap('a', 'b')}::INT AS repeated FROM q""")
def overlap_words(spark, sf_dir):
    """Both halves of each text; the second begins with up to 44 words of the first."""
    w, half = F.split("text", " "), F.floor(F.size("w") / 2).cast("int")
    start = F.greatest(F.lit(1), half + 1 - (F.col("doc_id") % 45).cast("int"))
    rows = documents(spark, sf_dir).withColumn("w", w)
    rows = rows.select("doc_id", F.array_join(F.slice("w", F.lit(1), half), " ").alias("a"), F.array_join(F.slice("w", start, F.greatest(F.size("w") - start + 1, F.lit(0))), " ").alias("b"))
    return rows.select("doc_id", T.word_overlap(F.col("a"), F.col("b")).alias("repeated"))


# Sections


BLANKED = "replace(text, chr(10), chr(10) || ' ' || chr(10))"


def blanked() -> F.Column:
    """Text whose lines are paragraphs."""
    return F.replace("text", F.lit("\n"), F.lit("\n \n"))


@query(f"""
WITH c AS (SELECT doc_id, {D.clean_text(BLANKED)} AS t FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\n[{D.SPACE}]*\\n'), lambda x: {D.strip('x')}), lambda x: x <> '') AS s FROM c),
u AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS i FROM s)
SELECT doc_id, i::INT AS section_index, {D.word_count('t')}::INT AS n_words, sha256(t) AS text_sha256 FROM u""")
def text_sections(spark, sf_dir):
    rows = S.exploded(documents(spark, sf_dir), S.text_sections(blanked()), "doc_id")
    return rows.select("doc_id", F.col("index").alias("section_index"), T.word_count(F.col("text")).alias("n_words"), F.sha2("text", 256).alias("text_sha256"))


@query(f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
u AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM l),
h AS (SELECT *, (i % 3 = 1 AND i > 1) AS head, sum((i % 3 = 1 AND i > 1)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM u),
b AS (SELECT doc_id, seg, max(CASE WHEN head THEN {D.strip("regexp_replace(t, '#+[" + D.SPACE + "]*$', '')")} END) AS heading,
      {D.strip("coalesce(string_agg(CASE WHEN NOT head THEN regexp_replace(t, '[" + D.SPACE + "]+$', '') END, chr(10) ORDER BY i), '')")} AS body FROM h GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1)::INT AS section_index, heading, {D.word_count('body')}::INT AS n_words,
       sha256({D.strip("regexp_replace(body, chr(10) || '{3,}', chr(10) || chr(10), 'g')")}) AS text_sha256 FROM b WHERE {D.word_count('body')} >= 15""")
def markdown_sections(spark, sf_dir):
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((i % 3 == 0) & (i > 0), F.concat(F.lit("## "), x)).otherwise(x)), "\n")
    rows = S.exploded(documents(spark, sf_dir), S.markdown_sections(marked), "doc_id")
    return rows.select("doc_id", F.col("index").alias("section_index"), "heading", T.word_count(F.col("text")).alias("n_words"), F.sha2("text", 256).alias("text_sha256"))


# Chunks

WHOLE = "SELECT doc_id, 0 AS sec, text FROM documents"
LINES = "SELECT doc_id, generate_subscripts(s, 1) - 1 AS sec, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)"
DIGEST = "SELECT doc_id, chunk_index, word_count, split_reason, n_sections, sha256(text) AS text_sha256 FROM chunks"


def chunk_rows(spark, sf_dir, sections, config=None) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", sections.alias("sections"))
    return chunking.chunk_documents(docs, config=config)


def digest(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_index", "word_count", "split_reason", F.size("source_section_indexes").alias("n_sections"), F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH RECURSIVE {D.chunks(WHOLE)} {DIGEST}")
def chunk_documents(spark, sf_dir):
    return digest(chunk_rows(spark, sf_dir, S.whole_section(F.col("text"))))


@query(f"WITH RECURSIVE {D.chunks(LINES)} {DIGEST}")
def chunk_lines(spark, sf_dir):
    return digest(chunk_rows(spark, sf_dir, S.line_sections(F.col("text"))))


@query(f"WITH RECURSIVE {D.chunks(LINES, keep=True)} {DIGEST}")
def chunk_boundaries(spark, sf_dir):
    return digest(chunk_rows(spark, sf_dir, S.line_sections(F.col("text")), chunking.ChunkConfig(keep_boundaries=True)))


@query(f"WITH RECURSIVE {D.chunks(WHOLE, target=60, most=90, least=20, extra=15)} {DIGEST}")
def chunk_overlap(spark, sf_dir):
    return digest(chunk_rows(spark, sf_dir, S.whole_section(F.col("text")), chunking.ChunkConfig(60, 90, 20, 15)))


# Packs

PACKED = f"""WITH RECURSIVE {D.chunks(WHOLE)},
tasks AS (SELECT 'pack__' || d.source || '_' || doc_id || '__c' || printf('%04d', chunk_index) AS task_id, d.source AS source_id, chunk_index, c.word_count, c.text, split_reason FROM chunks c JOIN documents d USING (doc_id))"""


def packed(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source").select("doc_id", "source", S.whole_section(F.col("text")).alias("sections"))
    rows = chunking.chunk_documents(docs)
    rows = rows.withColumn("doc_source", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))).withColumnRenamed("source", "source_id")
    return rows.withColumn("task_id", pack.task_id("pack", F.col("doc_source"), F.col("chunk_index")))


SKIPPED = "src3"


@query(f"""{PACKED}, s AS (SELECT source AS source_id, count(*) AS section_count, sum({D.word_count('text')}) AS word_count FROM documents GROUP BY 1)
SELECT source_id, section_count::BIGINT AS section_count, s.word_count::BIGINT AS word_count, count(task_id)::BIGINT AS chunk_count, count(*) FILTER (tasks.word_count < 120)::BIGINT AS low_quality_chunk_count
FROM s JOIN tasks USING (source_id) GROUP BY ALL""")
def pack_sources(spark, sf_dir):
    return indexed(spark, sf_dir).select("source_id", "section_count", "word_count", "chunk_count", "low_quality_chunk_count")


def indexed(spark, sf_dir, chunks: DataFrame | None = None) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    sections = docs.select(F.col("source").alias("source_id"), T.word_count(F.col("text")).alias("word_count"))
    sources = docs.select(F.col("source").alias("source_id"), (F.col("source") == SKIPPED).alias("skipped")).distinct()
    return pack.index_sources(sources, sections, packed(spark, sf_dir) if chunks is None else chunks)


@query(f"""{PACKED}, s AS (SELECT source AS source_id, count(*) AS n, sum({D.word_count('text')}) AS w FROM documents GROUP BY 1), c AS (SELECT source_id, count(*) AS k FROM tasks GROUP BY 1)
SELECT count(*)::BIGINT AS source_count, count(*) FILTER (source_id <> '{SKIPPED}')::BIGINT AS ingested_source_count, count(*) FILTER (source_id = '{SKIPPED}')::BIGINT AS skipped_source_count,
       sum(n) FILTER (source_id <> '{SKIPPED}')::BIGINT AS total_section_count, sum(w) FILTER (source_id <> '{SKIPPED}')::BIGINT AS total_word_count, sum(k) FILTER (source_id <> '{SKIPPED}')::BIGINT AS total_chunk_count
FROM s LEFT JOIN c USING (source_id)""")
def pack_totals(spark, sf_dir):
    return pack.index_totals(indexed(spark, sf_dir))


@query("""
WITH s AS (SELECT DISTINCT source, lang FROM documents), n AS (SELECT lang AS id, count(*) AS n FROM s GROUP BY 1)
SELECT id, coalesce(n, 0)::BIGINT AS source_count FROM n FULL JOIN (SELECT unnest(['de', 'en', 'it']) AS id) USING (id)""")
def bucket_counts(spark, sf_dir):
    sources = documents(spark, sf_dir, "source", "lang").groupBy("source").agg(F.collect_set("lang").alias("topic_bucket_ids"))
    return pack.bucket_counts(sources, spark.createDataFrame([("de",), ("en",), ("it",)], "id string"))


@query(f"{PACKED} SELECT source_id, count(*)::BIGINT AS flagged FROM tasks WHERE word_count < 120 GROUP BY 1")
def audit_chunks(spark, sf_dir):
    return pack.audit(packed(spark, sf_dir).withColumnRenamed("word_count", "chunk_word_count"))


@query(f"{PACKED} SELECT task_id, word_count AS chunk_word_count, source_id, left(replace(text, chr(10), ' '), 120) AS preview FROM tasks WHERE word_count < 120 ORDER BY task_id LIMIT 20")
def audit_preview(spark, sf_dir):
    return pack.audit_preview(packed(spark, sf_dir).withColumnRenamed("word_count", "chunk_word_count").withColumnRenamed("text", "source_content"))


TEMPLATE, SCHEMA_JSON = "Summarise what follows as JSON.\nSchema: {{SCHEMA}}\n---\n{{CONTENT}}", '{"title": "string"}'


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"""{PACKED} SELECT task_id, source_id, chunk_index, word_count AS chunk_word_count, split_reason, 0 AS section_index,
sha256(text) AS content_sha256, sha256(replace({sql_text(TEMPLATE.replace('{{SCHEMA}}', SCHEMA_JSON))}, '{{{{CONTENT}}}}', text)) AS prompt_sha256 FROM tasks""")
def task_rows(spark, sf_dir):
    rows = packed(spark, sf_dir).drop("task_id", "source_id").withColumnRenamed("doc_source", "source_id")
    made = pack.tasks(rows, "pack", TEMPLATE, SCHEMA_JSON)
    source = F.regexp_extract("source_id", r"^(.*)_\d+$", 1).alias("source_id")
    return made.select("task_id", source, "chunk_index", "chunk_word_count", "split_reason", "section_index", F.sha2("source_content", 256).alias("content_sha256"), F.sha2("prompt", 256).alias("prompt_sha256"))


@query(f"SELECT doc_id, sha256(replace({sql_text(TEMPLATE.replace('{{SCHEMA}}', SCHEMA_JSON))}, '{{{{CONTENT}}}}', text) || chr(10) || chr(10) || 'The last answer was rejected:' || chr(10) || '- ' || lang || chr(10) || '- ' || source) AS prompt_sha256 FROM documents")
def task_prompts(spark, sf_dir):
    prompt = pack.build_prompt(TEMPLATE, F.col("text"), SCHEMA_JSON)
    return documents(spark, sf_dir, "doc_id", "text", "lang", "source").select("doc_id", F.sha2(pack.retry_prompt(prompt, F.array("lang", "source")), 256).alias("prompt_sha256"))


# Export: documents are tasks, documents of good quality have a note

TASKS = """tasks AS (
  SELECT doc_id, 'pack__' || source || '__c' || printf('%04d', doc_id) AS task_id, source AS source_id, text AS source_content,
         CASE doc_id % 10 WHEN 0 THEN 'eval' WHEN 1 THEN 'holdout' WHEN 2 THEN NULL WHEN 3 THEN 'unassigned' ELSE 'train' END AS split FROM documents),
notes AS (SELECT 'pack__' || source || '__c' || printf('%04d', doc_id) AS task_id, '{"title":"' || lang || '"}' AS study_note FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"""
ROUTED = f"""WITH {TASKS},
routed AS (SELECT t.*, n.study_note, CASE WHEN n.study_note IS NULL THEN 'skipped_unenriched' WHEN split = 'train' THEN CASE WHEN {D.fraction('t.task_id')} < 0.2::DOUBLE THEN 'valid' ELSE 'train' END
  WHEN split IN ('eval', 'holdout') THEN split ELSE 'skipped_other_split' END AS bucket FROM tasks t LEFT JOIN notes n USING (task_id))"""


def task_table(spark, sf_dir) -> DataFrame:
    split = F.expr("CASE doc_id % 10 WHEN 0 THEN 'eval' WHEN 1 THEN 'holdout' WHEN 2 THEN NULL WHEN 3 THEN 'unassigned' ELSE 'train' END")
    rows = documents(spark, sf_dir, "doc_id", "text", "source", "lang")
    key = pack.task_id("pack", F.col("source"), F.col("doc_id"))
    return rows.select("doc_id", key.alias("task_id"), F.col("source").alias("source_id"), F.col("text").alias("source_content"), split.alias("split"), F.array("lang").alias("topic_bucket_ids"))


def routed(spark, sf_dir) -> DataFrame:
    tasks = task_table(spark, sf_dir)
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    note = F.concat(F.lit('{"title":"'), F.get("topic_bucket_ids", F.lit(0)), F.lit('"}'))
    notes = tasks.select("doc_id", "task_id", note.alias("study_note")).join(good, "doc_id", "left_semi")
    return export.route(tasks, notes, 0.2)


PROMPT = "You turn documents into notes."


@query(f"{ROUTED} SELECT task_id, bucket, 'system,user,assistant' AS roles, sha256({sql_text(PROMPT)} || chr(0) || source_content || chr(0) || study_note) AS content_sha256 FROM routed WHERE bucket IN ('train', 'valid')")
def training_pairs(spark, sf_dir):
    rows = export.training_pairs(routed(spark, sf_dir), PROMPT)
    contents = F.concat_ws("\0", F.transform("messages", lambda m: m["content"]))
    return rows.select("task_id", "bucket", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.sha2(contents, 256).alias("content_sha256"))


@query(f"{ROUTED} SELECT task_id, split, source_id, sha256(source_content) AS content_sha256, study_note AS reference_note FROM routed WHERE bucket IN ('eval', 'holdout')")
def eval_references(spark, sf_dir):
    rows = export.references(routed(spark, sf_dir))
    return rows.select("task_id", "split", "source_id", F.sha2("source_content", 256).alias("content_sha256"), "reference_note")


@query(f"{ROUTED} SELECT " + ", ".join(f"count(*) FILTER (bucket = '{b}')::BIGINT AS {b}" for b in export.BUCKETS) + " FROM routed")
def export_counts(spark, sf_dir):
    return export.counts(routed(spark, sf_dir))


@query(f"WITH {TASKS} SELECT CASE WHEN split IS NULL OR split IN ('', 'unassigned') THEN 'train' ELSE split END AS split, count(*)::BIGINT AS n FROM tasks GROUP BY 1")
def split_counts(spark, sf_dir):
    return task_table(spark, sf_dir).groupBy(export.force_train(F.col("split")).alias("split")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, n AS tokens FROM (SELECT doc_id, ceil({D.word_count('text')} * (4 / 3)::DOUBLE)::INT AS n FROM documents) WHERE n <= 512")
def length_filter(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("tokens", export.estimated_tokens(F.col("text")))
    return export.within_length(rows, F.col("tokens"), 512).select("doc_id", "tokens")


@query("SELECT conv_id, count(*)::INT AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles, sha256(string_agg(text, chr(0) ORDER BY turn)) AS content_sha256 FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL) GROUP BY conv_id")
def conversation_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("text is not null and role is not null").select("conv_id", "turn", "role", "text").distinct()
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return turns.select("conv_id", F.size("m").alias("n_messages"), F.array_join("m.role", ",").alias("roles"), F.sha2(F.concat_ws("\0", "m.text"), 256).alias("content_sha256"))


# Discovery: pages are links

HOSTS = [f"{p}{n}.example.{z}" for p in ("", "blog.", "m.", "www.") for n in ("tionsh", "thther", "ththan") for z in ("com", "net", "org")]
HOME = "docs.example.com"
RULES = {"english": ["/en/", "/1"], "even": [f"/{k}" for k in (2, 4, 6, 8)], "romance": ["/fr/", "/es/", "/3"]}
EXCLUDED = ["/de/", "/9"]


def sql_prefix(path: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"lower({path}) = rtrim('{p}', '/') OR starts_with(lower({path}), '{p}')" for p in prefixes) + ")"


NORMAL = f"""u AS (SELECT page_id, url, lower(regexp_extract(url, '^(\\w+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
  list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
normal AS (SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host IN ({", ".join(f"'{h}'" for h in HOSTS)})
  THEN 'https://{HOME}/' || array_to_string(CASE WHEN parts[1] IN ('aws', 'azure', 'gcp') AND parts[2] = 'en' THEN parts[3:] WHEN parts[1] = 'en' THEN parts[2:] ELSE parts END, '/') END AS url FROM u)"""
PATHS = f"WITH {NORMAL}, p AS (SELECT page_id, url, regexp_extract(url, '://[^/]*(/.*)$', 1) AS path FROM normal WHERE url IS NOT NULL)"
BUCKET_LIST = "list_filter([" + ", ".join(f"CASE WHEN {sql_prefix('path', v)} THEN '{k}' END" for k, v in RULES.items()) + "], lambda x: x IS NOT NULL)"


def normal_urls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", discovery.normalize_url(F.col("url"), HOSTS, HOME).alias("url"))


@query(f"WITH {NORMAL} SELECT page_id, url FROM normal")
def normalize_url(spark, sf_dir):
    return normal_urls(spark, sf_dir)


@query(f"{PATHS} SELECT page_id, {sql_prefix('path', EXCLUDED)} AS excluded FROM p")
def exclude_prefix(spark, sf_dir):
    return normal_urls(spark, sf_dir).filter("url is not null").select("page_id", discovery.is_excluded(discovery.url_path(F.col("url")), EXCLUDED).alias("excluded"))


@query(f"{PATHS} SELECT page_id, array_to_string({BUCKET_LIST}, ',') AS buckets FROM p")
def topic_match(spark, sf_dir):
    return normal_urls(spark, sf_dir).filter("url is not null").select("page_id", F.array_join(discovery.topic_buckets(discovery.url_path(F.col("url")), RULES), ",").alias("buckets"))


@query(f"{PATHS} SELECT page_id, array_to_string({BUCKET_LIST}, ',') AS buckets FROM p")
def topic_table(spark, sf_dir):
    """The same rules as a table, joined with the pages' paths."""
    rules = spark.createDataFrame([(i, bucket, prefix) for i, (bucket, prefixes) in enumerate(RULES.items()) for prefix in prefixes], "ord int, bucket string, prefix string")
    rows = normal_urls(spark, sf_dir).filter("url is not null")
    return discovery.match_prefix_rules(rows, discovery.url_path(F.col("url")), rules).select("page_id", F.array_join("buckets", ",").alias("buckets"))


@query(r"""
SELECT DISTINCT 'https://x/' || page_id || '/' || coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS loc FROM pages WHERE page_id % 5 > 0
UNION SELECT DISTINCT 'https://x/' || page_id AS loc FROM pages WHERE page_id % 5 = 0""")
def sitemap_index(spark, sf_dir):
    """Pages as sitemap files that an index names, read through it."""
    path = storage.new_path(spark, "sitemaps")
    place = F.coalesce(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1), F.lit(""))
    loc = F.concat(F.lit("https://x/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("/"), place)).otherwise(""))
    safe = F.replace(F.replace(loc, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    pages = table(spark, sf_dir, "pages")
    plain = F.concat(F.lit("<url><loc> "), safe, F.lit(" </loc><lastmod>2024-01-01</lastmod></url>"))
    prefixed = F.concat(F.lit("<s:url><s:loc>"), safe, F.lit("</s:loc></s:url>"))
    body = F.when(F.col("page_id") % 2 == 0, plain).otherwise(prefixed)
    rows = pages.select(F.floor(F.col("page_id") / 1000).alias("part"), "page_id", body.alias("body"))
    # A sitemap holds a thousand pages, and the index names all sitemaps.
    text = F.concat(F.lit('<urlset xmlns="http://x/0.9" xmlns:s="http://x/0.9">'), F.array_join(F.collect_list("body"), "\n"), F.lit("</urlset>")).alias("value")
    rows.groupBy("part").agg(text).write.partitionBy("part").text(path)
    entry = F.concat(F.lit("<sitemap><loc>https://x/part="), "part", F.lit("</loc></sitemap>"))
    named = rows.select("part").distinct().agg(F.concat(F.lit("<sitemapindex><sitemap><loc>https://x/index</loc></sitemap><sitemap><loc>other</loc></sitemap>"), F.array_join(F.collect_list(entry), ""), F.lit("</sitemapindex>")).alias("value"))
    named.write.text(f"{path}/index")
    local = lambda at: F.when(at.startswith("https://x/"), F.concat(F.lit(f"{path}/"), F.substring(at, 11, 1000)))
    return discovery.read_sitemaps(spark, [f"{path}/index"], local)


CANDIDATES = f"""{PATHS}, c AS (SELECT page_id, url AS original_url, page_id % 2 AS grp, 'doc_' || {D.slug("regexp_replace(path, '^/+|/+$', '', 'g')", 60, 'index')} AS source_id, array_to_string({BUCKET_LIST}, ',') AS buckets
  FROM p WHERE NOT {sql_prefix('path', EXCLUDED)} AND len({BUCKET_LIST}) > 0),
merged AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY grp, page_id) = 1),
known AS (SELECT original_url, source_id FROM c WHERE page_id % 4 = 0),
fresh AS (SELECT * FROM merged m WHERE m.original_url NOT IN (SELECT original_url FROM known) AND m.source_id NOT IN (SELECT source_id FROM known))"""


def all_candidates(spark, sf_dir) -> DataFrame:
    links = normal_urls(spark, sf_dir).filter("url is not null").select("url", F.lit("a page").alias("title"), F.lit("").alias("description"), (F.col("page_id") % 2).alias("group"), F.col("page_id").alias("ord"))
    return discovery.candidates(links, RULES, EXCLUDED, "docs", "sitemap", "About ")


@query(f"{CANDIDATES} SELECT source_id, original_url, buckets FROM merged")
def merge_candidates(spark, sf_dir):
    return discovery.merge_candidates(all_candidates(spark, sf_dir)).select("source_id", "original_url", F.array_join("topic_bucket_ids", ",").alias("buckets"))


def fresh_candidates(spark, sf_dir) -> DataFrame:
    every = all_candidates(spark, sf_dir)
    return discovery.new_candidates(discovery.merge_candidates(every), every.filter("ord % 4 = 0"))


@query(f"{CANDIDATES} SELECT source_id, original_url FROM fresh")
def new_candidates(spark, sf_dir):
    return fresh_candidates(spark, sf_dir).select("source_id", "original_url")


@query(f"{CANDIDATES} SELECT source_id, 'docs/' || source_id[5:] || '.md' AS local_path, (row_number() OVER (ORDER BY grp, page_id) + 99)::INT AS priority, 'train' AS split, true AS enabled FROM fresh")
def apply_candidates(spark, sf_dir):
    return discovery.apply_candidates(fresh_candidates(spark, sf_dir)).select("source_id", "local_path", "priority", "split", "enabled")


# The same rules as patterns, which only SQL uses: on long pages they are slower than the columns' way.
HIDDEN_RE = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
BLOCK_RE = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|th|thead|title|tr|ul)\b[^>]*>"
MARKDOWN_RE = (
    (r"(?is)<head\b[^>]*>.*?</head\s*>", "\n"),
    *((rf"(?is)<h{level}\b[^>]*>\s*(.*?)\s*</h{level}\s*>", "\n\n" + "#" * level + " $1\n\n") for level in range(1, 7)),
    (r"(?is)<pre\b[^>]*>(.*?)</pre\s*>", "\n```\n$1\n```\n"),
    (r"(?is)<code\b[^>]*>(.*?)</code\s*>", "`$1`"),
    (r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)\s*>", "**$1**"),
    (r'(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a\s*>', "[$2]($1)"),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)</p\s*>", "\n\n"),
)
HTML = f"regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN_RE}', chr(10), 'g'), '{BLOCK_RE}', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _entity, _char in H.ENTITIES:
    HTML = f"replace({HTML}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, sha256({D.clean_text('t')}) AS text_sha256, {D.word_count('t')}::INT AS n_words FROM (SELECT page_id, {HTML} AS t FROM pages)")
def html_to_text(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", T.clean_text(H.html_text(F.col("html"))).alias("t"))
    return rows.select("page_id", F.sha2("t", 256).alias("text_sha256"), T.word_count(F.col("t")).alias("n_words"))


@query(f"SELECT page_id, '# page ' || page_id || chr(10) || 'Source: ' || url AS header FROM (SELECT page_id, url, {HTML} AS t FROM pages) WHERE {D.word_count('t')} >= 80")
def thin_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").filter(T.word_count(H.html_text(F.col("html"))) >= 80)
    return rows.select("page_id", F.concat(F.lit("# page "), F.col("page_id").cast("string"), F.lit("\nSource: "), "url").alias("header"))


# Captions and transcripts: turns of conversations are cues


STAMP_SQL = "printf('%02d:%02d:%02d.%03d', (t // 3600)::INT, (t % 3600 // 60)::INT, (t % 60)::INT, {ms})"


def stamp(second: F.Column, ms: int) -> F.Column:
    return F.format_string(f"%02d:%02d:%02d.{ms:03d}", F.floor(second / 3600).cast("int"), F.floor(second % 3600 / 60).cast("int"), (second % 60).cast("int"))


TURNS = "t AS (SELECT DISTINCT conv_id, turn, replace(replace(text, chr(10), ' '), '-->', '') AS text FROM conversations WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1)"


def turns(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return rows.select("conv_id", "turn", F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("-->"), F.lit("")).alias("text"))


VTT = f"""WITH {TURNS}, c AS (SELECT conv_id, turn, {D.squeeze("regexp_replace(regexp_replace(text || ' <c>and</c> more', '<(?:[0-9]{1,2}:)?[0-9]{2}:[0-9]{2}[.,][0-9]{3}>', '', 'g'), '<[^>]+>', '', 'g')")} AS text FROM t)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS cue, round(turn * 70 + 0.25, 2)::DOUBLE AS start_s, round(turn * 70 + 9.5, 2)::DOUBLE AS end_s, sha256(text) AS text_sha256 FROM c WHERE text <> ''"""


@query(VTT)
def vtt_parse(spark, sf_dir):
    second = F.col("turn") * 70
    block = F.concat(F.col("turn").cast("string"), F.lit("\n"), stamp(second, 250), F.lit(" --> "), stamp(second + 9, 500), F.lit(" align:start\n"), "text", F.lit(" <c>and</c>\nmore"))
    files = turns(spark, sf_dir).groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\nNOTE made up\n\n"), F.array_join(F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))["b"], "\n\n")).alias("vtt"))
    rows = S.exploded(files, S.vtt_sections(F.col("vtt")), "conv_id")
    return rows.select("conv_id", F.col("index").alias("cue"), F.col("start_time_s").alias("start_s"), F.col("end_time_s").alias("end_s"), F.sha2("text", 256).alias("text_sha256"))


def timed(spark, sf_dir) -> DataFrame:
    """Segments of eight words, and all words, of each document, nine seconds each, with a pause after every seventh."""
    last = F.floor(F.size("w") / 8).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: S.section(index=k, text=F.array_join(F.slice("w", k * 8 + 1, 8), " "), start_time_s=k * 9.0 + F.floor(k / 7) * 20, end_time_s=k * 9.0 + F.floor(k / 7) * 20 + 9))
    return documents(spark, sf_dir).withColumn("w", T.words(F.col("text"))).select("doc_id", parts.alias("sections"))


MERGED = f"""
WITH RECURSIVE w AS (SELECT doc_id, {D.words("text")} AS w FROM documents),
raw AS (SELECT doc_id, k, array_to_string(w[k * 8 + 1:k * 8 + 8], ' ') AS text, k * 9 + k // 7 * 20 AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) // 8 + 1)) AS k FROM w)),
seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, text, s FROM raw WHERE text <> ''),
fold AS (
  SELECT doc_id, i, 1 AS part, text, s AS begins, s + 9 AS ends FROM seg WHERE i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN fits THEN part ELSE part + 1 END, CASE WHEN fits THEN joined ELSE text END, CASE WHEN fits THEN begins ELSE s END, s + 9
  FROM (SELECT g.doc_id, g.i, f.part, g.text, f.begins, g.s, joined, g.s - f.ends <= 8 AND len(string_split(joined, ' ')) <= 100 AND g.s + 9 - f.begins <= 60 AS fits
        FROM fold f JOIN seg g ON g.doc_id = f.doc_id AND g.i = f.i + 1,
        LATERAL (SELECT {D.overlap('f.text', 'g.text')} AS n),
        LATERAL (SELECT CASE WHEN contains(lower(f.text), lower(g.text)) THEN f.text WHEN n >= len(string_split(g.text, ' ')) THEN f.text ELSE f.text || ' ' || array_to_string(string_split(g.text, ' ')[n + 1:], ' ') END AS joined)))
SELECT doc_id, (part - 1)::INT AS part, arg_max(begins, i)::DOUBLE AS start_s, max(ends)::DOUBLE AS end_s, sha256(arg_max(text, i)) AS text_sha256 FROM fold GROUP BY doc_id, part"""


@query(MERGED)
def transcript_merge(spark, sf_dir):
    small_batches(spark)
    own = timed(spark, sf_dir).withColumn("sections", transcript.merge_transcript(F.col("sections")))
    # explode() would filter by its size first, which merges twice and splits the text anew for each segment
    flat = own.select("doc_id", F.explode_outer("sections").alias("section")).filter("section is not null").select("doc_id", "section.*")
    return flat.select("doc_id", F.col("index").alias("part"), F.col("start_time_s").alias("start_s"), F.col("end_time_s").alias("end_s"), F.sha2("text", 256).alias("text_sha256"))


@query("""
WITH e AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 21600 THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM e""")
def gap_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return transcript.gap_sessions(events, "user_id", ["ts", "event_id"], F.col("s"), F.col("s"), 21600.0).select("event_id", "user_id", "session")


# Answers of models: made from documents, broken in various ways

ANSWERS = """answers AS (
  SELECT doc_id, text AS source, CASE doc_id % 6
    WHEN 0 THEN json WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || json || chr(10) || '```' WHEN 2 THEN '<tool_call name="x">' || json || '</TOOL_CALL>'
    WHEN 3 THEN 'no answer' WHEN 4 THEN json || ' {"more": 1}' ELSE '[1, 2]' END AS answer, json
  FROM (SELECT doc_id, text, '{"title":"' || lang || '","summary":"' || CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE source END || '","key_concepts":[{"concept":"'
    || a || '","simple_explanation":"b","why_it_matters":' || CASE WHEN doc_id % 7 = 0 THEN '1' ELSE '"c"' END || '}],"important_features_or_tools":[{"name":"' || b
    || '","type":"t","what_it_does":"w","when_to_use_it":"u","important_parameters":' || CASE doc_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '[{"parameter":"nowhere to be found","meaning":"m","example_value":2}]' ELSE '{}' END
    || '}],"practical_workflow":[{"step":' || CASE WHEN doc_id % 4 = 0 THEN '"1"' ELSE '1' END || ',"action":"a","reason":"r"}],"common_mistakes_or_confusions":[],"project_usage_notes":["n"]'
    || CASE WHEN doc_id % 11 = 0 THEN ',"zzz":1' ELSE '' END || '}' AS json
  FROM (SELECT *, regexp_extract(text, '([a-zA-Z]+) [a-zA-Z]+', 1) AS a, regexp_extract(text, '([a-zA-Z]+ [a-zA-Z]+)', 1) AS b FROM documents)))"""


def answers(spark, sf_dir) -> DataFrame:
    """The same expression, in Spark's SQL."""
    rows = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    rows = rows.withColumns({"a": F.regexp_extract("text", "([a-zA-Z]+) [a-zA-Z]+", 1), "b": F.regexp_extract("text", "([a-zA-Z]+ [a-zA-Z]+)", 1)})
    k = F.col("doc_id")
    lit = F.lit
    note = F.concat(
        lit('{"title":"'), "lang", lit('","summary":"'), F.when(k % 5 == 0, " ").otherwise(F.col("source")), lit('","key_concepts":[{"concept":"'), "a",
        lit('","simple_explanation":"b","why_it_matters":'), F.when(k % 7 == 0, "1").otherwise('"c"'), lit('}],"important_features_or_tools":[{"name":"'), "b",
        lit('","type":"t","what_it_does":"w","when_to_use_it":"u","important_parameters":'),
        F.when(k % 3 == 0, "null").when(k % 3 == 1, '[{"parameter":"nowhere to be found","meaning":"m","example_value":2}]').otherwise("{}"),
        lit('}],"practical_workflow":[{"step":'), F.when(k % 4 == 0, '"1"').otherwise("1"),
        lit(',"action":"a","reason":"r"}],"common_mistakes_or_confusions":[],"project_usage_notes":["n"]'), F.when(k % 11 == 0, ',"zzz":1').otherwise(""), lit("}"),
    )
    json = F.col("json")
    answer = (
        F.when(k % 6 == 0, json).when(k % 6 == 1, F.concat(lit("Here it is:\n```json\n"), json, lit("\n```")))
        .when(k % 6 == 2, F.concat(lit('<tool_call name="x">'), json, lit("</TOOL_CALL>"))).when(k % 6 == 3, "no answer")
        .when(k % 6 == 4, F.concat(json, lit(' {"more": 1}'))).otherwise("[1, 2]")
    )
    return rows.withColumn("json", note).select("doc_id", F.col("text").alias("source"), answer.alias("answer"), "json")


@query(f"WITH {ANSWERS} SELECT doc_id, sha256(trim(regexp_replace(answer, '<\\s*/?\\s*tool_call(?:[\\s/][^>]*)?>', '', 'gi'))) AS answer_sha256 FROM answers")
def sanitize(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", F.sha2(T.sanitize_response(F.col("answer")), 256).alias("answer_sha256"))


@query(f"WITH {ANSWERS} SELECT doc_id, doc_id % 6 < 3 AS ok, CASE WHEN doc_id % 6 < 3 THEN json->>'$.title' END AS title, CASE doc_id % 6 WHEN 3 THEN 'the answer holds no JSON object' WHEN 4 THEN 'the answer holds invalid JSON' WHEN 5 THEN 'the answer is no JSON object' END AS error FROM answers")
def json_extract(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn("p", validation.checked(F.col("answer")))
    return rows.select("doc_id", F.col("p.json").isNotNull().alias("ok"), F.get_json_object("p.json", "$.title").alias("title"), "p.error")


NOTE_ERRORS = """list_filter([
  CASE WHEN json_type(json, '$.title') <> 'VARCHAR' OR trim(json->>'$.title') = '' THEN 'title must be a non-empty string' END,
  CASE WHEN json_type(json, '$.summary') <> 'VARCHAR' OR trim(json->>'$.summary') = '' THEN 'summary must be a non-empty string' END,
  CASE WHEN trim(json->>'$.key_concepts[0].concept') = '' THEN 'key_concepts[0].concept must be a non-empty string' END,
  CASE WHEN json_type(json, '$.key_concepts[0].why_it_matters') <> 'VARCHAR' THEN 'key_concepts[0].why_it_matters must be a non-empty string' END,
  CASE WHEN trim(json->>'$.important_features_or_tools[0].name') = '' THEN 'important_features_or_tools[0].name must be a non-empty string' END,
  CASE WHEN json_type(json, '$.important_features_or_tools[0].important_parameters') NOT IN ('ARRAY', 'NULL') THEN 'important_features_or_tools[0].important_parameters must be a list' END,
  CASE WHEN json_type(json, '$.practical_workflow[0].step') NOT IN ('UBIGINT', 'BIGINT') THEN 'practical_workflow[0].step must be an integer' END,
  CASE WHEN json_exists(json, '$.zzz') THEN 'unknown keys: zzz' END], lambda x: x IS NOT NULL)"""


@query(f"WITH {ANSWERS} SELECT doc_id, len({NOTE_ERRORS})::INT AS n_errors, array_to_string({NOTE_ERRORS}, '; ') AS errors FROM answers")
def note_errors(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn("e", validation.checked(F.col("json"))["errors"])
    return rows.select("doc_id", F.size("e").alias("n_errors"), F.array_join("e", "; ").alias("errors"))


@query("""
SELECT doc_id, CASE WHEN good THEN g END::INT AS groundedness, CASE WHEN good THEN 3 END::INT AS completeness, CASE WHEN good THEN s END::INT AS schema_quality, NOT good AS failed
FROM (SELECT doc_id, (doc_id % 8)::INT AS g, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1 + doc_id % 3 END AS s, coalesce((doc_id % 8) BETWEEN 1 AND 5, false) AND doc_id % 5 <> 0 AS good FROM documents)""")
def judge_scores(spark, sf_dir):
    k = F.col("doc_id")
    json = F.concat(F.lit('{"groundedness":'), (k % 8).cast("string"), F.lit(',"completeness":3,"schema_quality":'), F.when(k % 5 == 0, '"4"').otherwise((1 + k % 3).cast("string")), F.lit("}"))
    rows = documents(spark, sf_dir, "doc_id").select("doc_id", validation.verdict(F.parse_json(json)).alias("v"))
    return rows.select("doc_id", "v.groundedness", "v.completeness", "v.schema_quality", F.col("v.error").isNotNull().alias("failed"))


FORM = "trim(regexp_replace(regexp_replace(lower({t}), '[`''\"()\\[\\]{{}}*_]', ' ', 'g'), '[" + D.SPACE.replace("{", "{{").replace("}", "}}") + "]+', ' ', 'g'))"
GROUNDED = f"""list_filter(names, lambda n: NOT ({FORM.format(t='n')} = '' OR contains(form, {FORM.format(t='n')}) OR
  (len(list_filter(string_split({FORM.format(t='n')}, ' '), lambda w: length(w) > 2)) > 0 AND len(list_filter(string_split({FORM.format(t='n')}, ' '), lambda w: length(w) > 2 AND NOT contains(form, w))) = 0)))"""
CLAIMED = f"""{ANSWERS}, claims AS (SELECT doc_id, {FORM.format(t='source')} AS form, list_filter(list_transform([json->>'$.important_features_or_tools[0].name',
  json->>'$.important_features_or_tools[0].important_parameters[0].parameter', json->>'$.key_concepts[0].concept'], lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS names FROM answers),
scored AS (SELECT doc_id, len(names) AS claimed, {GROUNDED} AS missing, CASE WHEN len(names) = 0 THEN 1.0::DOUBLE ELSE (len(names) - len({GROUNDED}))::DOUBLE / len(names) END AS score FROM claims)"""


@query(f"WITH {CLAIMED} SELECT doc_id, claimed::INT AS claimed, array_to_string(missing, '; ') AS ungrounded, score FROM scored")
def groundedness(spark, sf_dir):
    rows = evaluation.with_groundedness(answers(spark, sf_dir), evaluation.claimed_names(F.col("json")), F.col("source"))
    return rows.select("doc_id", "claimed", F.array_join("ungrounded", "; ").alias("ungrounded"), "score")


def evaluated(spark, sf_dir) -> DataFrame:
    """Documents evaluated with the made-up answers, half of them from the cache."""
    rows = answers(spark, sf_dir).select(F.col("doc_id").alias("task_id"), F.col("source").alias("source_content"), "answer")
    cached = rows.filter("task_id % 2 = 0").select("task_id", F.col("answer").alias("raw_output"))
    cached = cached.unionByName(cached)  # a cache may hold a task twice
    return evaluation.evaluate(rows, lambda _: F.col("answer"), cached)


EVALUATED = f"""WITH {CLAIMED}, rows AS (SELECT a.doc_id AS task_id, a.doc_id % 6 < 3 AS json_valid, a.doc_id % 6 < 3 AND len({NOTE_ERRORS}) = 0 AS schema_valid, CASE WHEN a.doc_id % 6 < 3 THEN score END AS score FROM answers a JOIN scored USING (doc_id))"""


@query(f"{EVALUATED} SELECT task_id, json_valid, schema_valid, score FROM rows")
def eval_rows(spark, sf_dir):
    return evaluated(spark, sf_dir).select("task_id", "json_valid", "schema_valid", "score")


def rounded(*names: str) -> list:
    return [F.round(F.col(n), 9).alias(n) for n in names]


@query(f"{EVALUATED} SELECT count(*)::BIGINT AS tasks, round(avg(json_valid::INT), 9) AS json_valid_rate, round(avg(schema_valid::INT), 9) AS schema_valid_rate, round(avg(score), 9) AS mean_groundedness FROM rows")
def eval_metrics(spark, sf_dir):
    return evaluation.metrics(evaluated(spark, sf_dir)).select("tasks", *rounded("json_valid_rate", "schema_valid_rate", "mean_groundedness"))


@query(f"""{EVALUATED}, m AS (SELECT 'm' || task_id % 2 AS model, count(*)::VARCHAR AS tasks, (count(*) FILTER (json_valid))::VARCHAR AS valid FROM rows GROUP BY 1)
SELECT 'tasks' AS metric, max(tasks) FILTER (model = 'm0') AS m0, max(tasks) FILTER (model = 'm1') AS m1, '-' AS m2 FROM m
UNION ALL SELECT 'valid', max(valid) FILTER (model = 'm0'), max(valid) FILTER (model = 'm1'), '-' FROM m""")
def eval_compare(spark, sf_dir):
    rows = evaluated(spark, sf_dir).withColumn("model", F.concat(F.lit("m"), (F.col("task_id") % 2).cast("string")))
    by_model = rows.groupBy("model").agg(F.count("*").alias("tasks"), F.count_if("json_valid").alias("valid"))
    return evaluation.compare(by_model, ["m0", "m1", "m2"], ["tasks", "valid"])


# Enrichment with a model that fails by rule

TRIED = f"""WITH {ANSWERS}, tried AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'request' WHEN doc_id % 6 < 3 AND len({NOTE_ERRORS}) = 0 THEN 'ok' ELSE 'bad' END AS first, doc_id % 2 = 0 AS mended FROM answers),
attempts AS (SELECT doc_id, first = 'ok' AS ok, false AS retried, first <> 'request' AS billed FROM tried UNION ALL SELECT doc_id, mended, true, true FROM tried WHERE first <> 'ok')"""


def attempts(spark, sf_dir) -> enrichment.Rounds:
    rows = answers(spark, sf_dir).select(F.col("doc_id").cast("string").alias("task_id"), F.lit("ask").alias("prompt"), "answer", "json")

    def model(prompt):
        number = F.col("task_id").cast("long")
        again = F.startswith(prompt, F.lit("ask\n"))
        fixed = F.lit('{"title":"t","summary":"s","key_concepts":[],"important_features_or_tools":[],"practical_workflow":[],"common_mistakes_or_confusions":[],"project_usage_notes":[]}')
        text = F.when(again, F.when(number % 2 == 0, fixed).otherwise("never")).otherwise(F.col("made"))
        failed = ~again & (number % 13 == 0)
        return F.struct(F.when(~failed, text).alias("text"), F.when(failed, "timeout").alias("error"), F.lit(10).alias("input_tokens"), F.when(number % 3 == 0, 5).alias("output_tokens"))

    return enrichment.enrich(rows.withColumnRenamed("answer", "made").drop("json"), model)


@query(f"{TRIED} SELECT doc_id::VARCHAR AS task_id, ok, retried FROM attempts")
def enrich_rounds(spark, sf_dir):
    return attempts(spark, sf_dir).attempts.select("task_id", F.col("note").isNotNull().alias("ok"), "retried")


@query(f"""{TRIED} SELECT 100 AS tasks_total, 7 AS already_done, count(*) FILTER (ok)::BIGINT AS newly_enriched, count(*) FILTER (retried)::BIGINT AS retried, count(*) FILTER (retried AND NOT ok)::BIGINT AS rejected,
(10 * count(*) FILTER (billed))::BIGINT AS input_tokens, (5 * count(*) FILTER (billed AND doc_id % 3 = 0))::BIGINT AS output_tokens FROM attempts""")
def enrich_summary(spark, sf_dir):
    return enrichment.summary(attempts(spark, sf_dir).attempts, 100, 7)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def pending_tasks(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "task_id")
    tasks = documents(spark, sf_dir, "doc_id").withColumnRenamed("doc_id", "task_id")
    return enrichment.pending(tasks, labels.filter("quality = 1"), labels.filter("toxic = 1")).select(F.col("task_id").alias("doc_id"))


# Manifests, folders, captions, playlists


@query(r"""
WITH f AS (SELECT source || '/' || (doc_id % 40) || '_' || lang || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.pdf' END AS path FROM documents),
p AS (SELECT DISTINCT path FROM f),
b AS (SELECT path, regexp_extract(path, '([^/]+)\.[a-z]+$', 1) AS base, string_split(path, '/') AS parts FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY parts) AS k, row_number() OVER (ORDER BY parts) AS priority FROM b),
o AS (SELECT *, CASE WHEN k = 1 THEN base ELSE base || '_' || substr(sha256(path), 1, 4) END AS id FROM n),
c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k > 1, priority) AS clash FROM o)
SELECT path AS local_path, CASE WHEN clash > 1 THEN base || '_' || substr(sha256(path || ':' || substr(sha256(path), 1, 4)), 1, 4) ELSE id END AS source_id, replace(base, '_', ' ') AS title, priority::INT AS priority,
       CASE WHEN path LIKE '%.txt' THEN 'article' ELSE 'documentation' END AS resource_type FROM c""")
def unique_ids(spark, sf_dir):
    suffix = F.expr("CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.pdf' END")
    files = documents(spark, sf_dir, "doc_id", "source", "lang").select(F.concat("source", F.lit("/"), (F.col("doc_id") % 40).cast("string"), F.lit("_"), "lang", suffix).alias("path")).distinct()
    return M.folder_sources(files, ["a"]).select("local_path", "source_id", "title", "priority", "resource_type")


@query("""
WITH k AS (SELECT doc_id, doc_id % 9 AS m FROM documents)
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN m = 1 THEN 'manifest_version is not supported' END, CASE WHEN m = 2 THEN 'title must be a non-empty string' END, CASE WHEN m = 3 THEN 'sources[1].source_id is a duplicate' END,
  CASE WHEN m = 4 THEN 'sources[0].resource_type is not supported' END, CASE WHEN m = 5 THEN 'sources[0].enabled must be a boolean' END, CASE WHEN m = 6 THEN 'sources[0].topic_bucket_ids names an unknown bucket' END,
  CASE WHEN m = 7 THEN 'sources[0].split is not supported' END, CASE WHEN m = 8 THEN 'sources[0].priority must be an integer' END], lambda x: x IS NOT NULL), '; ') AS errors FROM k""")
def manifest_errors(spark, sf_dir):
    m = F.col("doc_id") % 9
    pick = lambda n, bad, good: F.when(m == n, bad).otherwise(good)
    source = F.concat(
        F.lit('{"source_id":"a","title":"A","resource_type":"'), pick(4, "film", "article"), F.lit('","local_path":"a.md","topic_bucket_ids":["'), pick(6, "y", "x"),
        F.lit('"],"split":"'), pick(7, "dev", "train"), F.lit('","priority":'), pick(8, '"1"', "1"), F.lit(',"enabled":'), pick(5, '"no"', "true"), F.lit("}"),
    )
    other = F.concat(F.lit('{"source_id":"'), pick(3, "a", "b"), F.lit('","title":"B","resource_type":"article","local_path":"b.md","topic_bucket_ids":["x"]}'))
    json = F.concat(
        F.lit('{"manifest_version":"'), pick(1, "2.0", "1.0"), F.lit('","pack_id":"p","title":"'), pick(2, " ", "T"), F.lit('","domain":"d","topic_buckets":[{"id":"x","label":"X"}],"sources":['), source, F.lit(","), other, F.lit("]}"),
    )
    rows = documents(spark, sf_dir, "doc_id").select("doc_id", F.from_json(json, M.SCHEMA).alias("m")).select("doc_id", "m.*")
    return rows.select("doc_id", F.array_join(M.manifest_errors(rows), "; ").alias("errors"))


@query("""
WITH t AS (SELECT doc_id AS video_id, CASE WHEN doc_id % 2 = 0 THEN 'manual' ELSE 'automatic' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'en-GB' WHEN 2 THEN 'fr' ELSE 'en' END AS key FROM documents)
SELECT video_id, CASE WHEN key = 'fr' THEN 'automatic' ELSE kind END AS kind, CASE WHEN key = 'fr' THEN 'en-US' ELSE key END AS key, CASE WHEN key = 'fr' THEN 'u2' ELSE 'u1' END AS url FROM t""")
def caption_choice(spark, sf_dir):
    kind = F.expr("CASE WHEN doc_id % 2 = 0 THEN 'manual' ELSE 'automatic' END")
    key = F.expr("CASE doc_id % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'en-GB' WHEN 2 THEN 'fr' ELSE 'en' END")
    track = lambda k, v, key_ord, at, ext, url: F.struct(k.alias("kind"), v.alias("key"), F.lit(key_ord).alias("key_ord"), F.lit(at).alias("ord"), F.lit(ext).alias("ext"), F.lit(url).alias("url"))
    tracks = F.array(track(kind, key, 0, 0, "srv3", "u0"), track(kind, key, 0, 1, "vtt", "u1"), track(F.lit("automatic"), F.lit("en-US"), 5, 2, "vtt", "u2"))
    rows = documents(spark, sf_dir, "doc_id").select(F.col("doc_id").alias("video_id"), F.explode(tracks).alias("t")).select("video_id", "t.*")
    return discovery.choose_captions(rows)


@query("""
WITH p AS (SELECT DISTINCT source FROM documents),
e AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS pos, doc_id FROM documents),
c AS (SELECT 'pl_' || source || '_' || printf('%02d', pos) || '_talk_' || doc_id AS source_id, 50 + pos AS priority, true AS enabled FROM e WHERE doc_id % 7 <> 0)
SELECT source_id, priority::INT AS priority, enabled FROM c UNION ALL SELECT 'video_' || source || '_playlist', 50, false FROM p""")
def playlist_expand(spark, sf_dir):
    """Sources are playlists and their documents the entries."""
    docs = documents(spark, sf_dir, "doc_id", "source").withColumn("playlist_id", F.concat(F.lit("video_"), "source", F.lit("_playlist")))
    pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    url = F.concat(F.lit("https://v.example.com/"), F.col("doc_id").cast("string"))
    entries = docs.select("playlist_id", pos.alias("pos"), F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Talk #"), F.col("doc_id").cast("string")).alias("title"), url.alias("url"))
    playlists = docs.select(F.col("playlist_id").alias("source_id"), F.lit(50).alias("priority"), F.lit("train").alias("split"), F.array(F.lit("x")).alias("topic_bucket_ids"), F.lit(True).alias("enabled")).distinct()
    known = docs.filter("doc_id % 7 = 0").select(url.alias("original_url"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("source_id"))
    return discovery.expand_playlists(playlists, entries, known).select("source_id", "priority", "enabled")


@query("SELECT page_id, url AS link, 'page ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'not a link' ELSE 'about it' END AS description, url || '.xml' AS loc FROM pages")
def link_index(spark, sf_dir):
    number = F.col("page_id").cast("string")
    entry = F.concat(F.lit("# Index\n\n - [page "), number, F.lit("]("), "url", F.lit(")"), F.when(F.col("page_id") % 2 == 0, "").otherwise(" - about it"), F.lit("\n- not a link\n"))
    xml = F.concat(F.lit('<urlset xmlns="x"><url><s:loc> '), "url", F.lit(".xml </s:loc></url></urlset>"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(discovery.parse_link_index(entry)).alias("l"), F.get(discovery.parse_sitemap(xml), F.lit(0)).alias("loc"))
    return rows.select("page_id", F.col("l.url").alias("link"), "l.title", "l.description", "loc")


@query("SELECT doc_id, n_chars::BIGINT AS tasks, (doc_id % 50)::BIGINT AS done FROM documents")
def log_stats(spark, sf_dir):
    line = F.concat(F.lit("summary tasks="), F.col("n_chars").cast("string"), F.lit(", done="), (F.col("doc_id") % 50).cast("string"), F.lit(" mode=x"))
    rows = documents(spark, sf_dir, "doc_id", "n_chars").select("doc_id", T.log_values(line, ["tasks", "done"]).alias("v"))
    return rows.select("doc_id", "v.tasks", "v.done")


@query("""
SELECT doc_id::VARCHAR AS task_id, CASE WHEN doc_id % 4 > 0 THEN lang END AS text, CASE WHEN doc_id % 4 = 0 THEN 'batch result: expired' END AS error, CASE WHEN doc_id % 4 > 0 THEN 9 END AS input_tokens
FROM documents WHERE doc_id % 3 > 0""")
def batch_remap(spark, sf_dir):
    tasks = documents(spark, sf_dir, "doc_id", "lang").select(F.col("doc_id").cast("string").alias("task_id"), "doc_id", F.col("lang").alias("prompt"))
    kind = F.when(F.col("doc_id") % 4 == 0, "expired").otherwise("succeeded")
    results = tasks.filter("doc_id % 3 > 0").select(T.request_key(F.col("task_id")).alias("request_key"), kind.alias("kind"), F.col("prompt").alias("text"), F.lit(9).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    return batches.remap(results, tasks).select("task_id", "answer.text", "answer.error", "answer.input_tokens")


@query(r"""
WITH n AS (SELECT page_id, url || ' (copy).md ' AS name, CASE page_id % 4 WHEN 0 THEN 'https://youtu.be/a' || page_id || '/' WHEN 1 THEN 'https://www.youtube.com/watch?x=1&v=b.' || page_id WHEN 2 THEN ' HTTP://YouTube.com/' ELSE url END AS video FROM pages)
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9._-]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'uploaded_file') AS file_name, page_id % 4 < 3 AS is_video,
       CASE page_id % 4 WHEN 0 THEN 'a' || page_id WHEN 1 THEN 'b_' || page_id ELSE 'youtube_source' END AS video_id FROM n""")
def safe_names(spark, sf_dir):
    k = F.col("page_id")
    video = (
        F.when(k % 4 == 0, F.concat(F.lit("https://youtu.be/a"), k.cast("string"), F.lit("/"))).when(k % 4 == 1, F.concat(F.lit("https://www.youtube.com/watch?x=1&v=b."), k.cast("string")))
        .when(k % 4 == 2, " HTTP://YouTube.com/").otherwise(F.col("url"))
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit(" (copy).md ")).alias("name"), video.alias("video"))
    return rows.select("page_id", N.safe_file_name(F.col("name")).alias("file_name"), N.is_video_url(F.col("video")).alias("is_video"), N.video_id(F.trim("video")).alias("video_id"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 8.5::DOUBLE END AS peak_mem_gb, 20 AS last_train_iter, ((n_chars % 100) / 100.0)::DOUBLE AS last_train_loss, CASE WHEN doc_id % 2 = 0 THEN 10 END AS last_val_iter FROM documents")
def training_log(spark, sf_dir):
    loss = F.format_string("%.2f", (F.col("n_chars") % 100) / 100.0)
    log = F.concat(F.lit("Iter 10: Train loss 9.9\n"), F.when(F.col("doc_id") % 2 == 0, "Iter 10: Val loss 1.25, took 3s\n").otherwise(""), F.lit("Iter 20: Train loss "), loss, F.lit(", x\n"), F.when(F.col("doc_id") % 3 == 0, "Peak mem 8.5 GB").otherwise(""))
    rows = documents(spark, sf_dir, "doc_id", "n_chars").select("doc_id", N.training_figures(log).alias("v"))
    return rows.select("doc_id", "v.peak_mem_gb", "v.last_train_iter", "v.last_train_loss", "v.last_val_iter")


@query("SELECT conv_id AS video_id, CASE WHEN conv_id % 3 = 0 THEN 'speech' ELSE 'captions' END AS origin FROM (SELECT DISTINCT conv_id FROM conversations)")
def caption_fallback(spark, sf_dir):
    videos = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id")).distinct()
    made = F.when(F.col("video_id") % 3 == 0, F.slice(S.whole_section(F.lit("x")), 1, 0)).otherwise(S.whole_section(F.lit("x")))
    return transcript.captions_or_speech(videos.withColumn("sections", made), videos.withColumn("sections", S.whole_section(F.lit("y")))).select("video_id", "origin")


@query("SELECT doc_id, source AS source_id, lang AS split, n_chars::BIGINT AS pages FROM documents")
def provenance(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars").withColumn("source_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    metadata = F.concat(F.lit('{"pages": '), F.col("n_chars").cast("string"), F.lit(" }"))
    sources = docs.select("source_id", F.col("lang").alias("split"))
    rows = pack.with_provenance(docs.select("doc_id", "source_id", metadata.alias("format_metadata")), sources)
    v = F.from_json("format_metadata", "pages long, source_pack struct<source_id: string, split: string>")
    return rows.select("doc_id", F.substring_index(v["source_pack"]["source_id"], "/", 1).alias("source_id"), v["source_pack"]["split"].alias("split"), v["pages"].alias("pages"))


# Files and documents


SUFFIXES = [".txt", ".MD", ".vtt", ".xyz", "", ".mp3", ".text"]
KINDS = ["text", "markdown", "captions", None, None, None, "text"]


def made_paths(spark, sf_dir) -> DataFrame:
    suffix = F.get(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % len(SUFFIXES)).cast("int"))
    return documents(spark, sf_dir, "doc_id", "source").select("doc_id", F.concat("source", F.lit("/a.b/file"), F.col("doc_id").cast("string"), suffix).alias("path"))


@query(f"SELECT doc_id, lower({SUFFIXES}[(doc_id % {len(SUFFIXES)})::INT + 1]) AS suffix, [{', '.join('NULL' if k is None else repr(k) for k in KINDS)}][(doc_id % {len(KINDS)})::INT + 1] AS reader FROM documents")
def route_files(spark, sf_dir):
    return made_paths(spark, sf_dir).select("doc_id", files.suffix_of(F.col("path")).alias("suffix"), files.reader_of(F.col("path")).alias("reader"))


@query(f"SELECT count(*) FILTER (k IS NOT NULL)::BIGINT AS supported, count(*) FILTER (k IS NULL)::BIGINT AS unsupported FROM (SELECT [{', '.join('NULL' if k is None else repr(k) for k in KINDS)}][(doc_id % {len(KINDS)})::INT + 1] AS k FROM documents)")
def unsupported_files(spark, sf_dir):
    good = files.reader_of(F.col("path")).isNotNull()
    return made_paths(spark, sf_dir).agg(F.count_if(good).alias("supported"), F.count_if(~good).alias("unsupported"))


@query(r"SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g') END) AS text_sha256 FROM documents")
def decode_text(spark, sf_dir):
    """Texts as bytes of UTF-8 or Latin-1 with the ends of lines of other systems."""
    ragged_ends = F.replace("text", F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, "\r\n").otherwise("\r"))
    content = F.when(F.col("doc_id") % 2 == 0, F.encode(ragged_ends, "UTF-8")).otherwise(F.encode(F.regexp_replace(ragged_ends, r"[^\x00-\xFF]", "?"), "ISO-8859-1"))
    return documents(spark, sf_dir).select("doc_id", F.sha2(files.decoded(content), 256).alias("text_sha256"))


def escaped(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"([\\()])", r"\\$1")


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM (SELECT doc_id, regexp_replace(text, '[^\n -~\x{{A0}}-\x{{FF}}]', ' ', 'g') AS text FROM documents)),
s AS (SELECT doc_id, page, {D.strip('t')} AS t FROM l),
c AS (SELECT *, length(t) AS n, len(regexp_extract_all(t, '[^{D.SPACE}]')) AS solid, len(regexp_extract_all(t, '[\pL\pN]')) AS alnum, len(regexp_extract_all(t, '\pC')) AS hidden FROM s)
SELECT doc_id, page::INT AS page_number, (row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1)::INT AS section_index, sha256(t) AS text_sha256
FROM c WHERE n > 0 AND NOT ((n - hidden) * 10 < n * 9 OR alnum * 2 < solid)""")
def pdf_pages(spark, sf_dir):
    """Documents as PDF files, a page for each line, read again."""
    small_batches(spark)
    clean = F.regexp_replace("text", r"[^\n -~\u00A0-\u00FF]", " ")
    page = lambda x, i: F.concat(
        (i * 2 + 10).cast("string"), F.lit(" 0 obj\n<</Type /Page /Contents "), (i * 2 + 11).cast("string"), F.lit(" 0 R>>\nendobj\n"),
        (i * 2 + 11).cast("string"), F.lit(" 0 obj\n<<>>\nstream\nBT /F1 12 Tf 10 700 Td ("), escaped(x), F.lit(") Tj ET\nendstream\nendobj\n"),
    )
    kids = F.array_join(F.transform(F.split("clean", "\n"), lambda x, i: F.concat((i * 2 + 10).cast("string"), F.lit(" 0 R"))), " ")
    body = F.array_join(F.transform(F.split("clean", "\n"), page), "")
    whole = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<</Type /Catalog /Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type /Pages /Kids ["), kids, F.lit("]>>\nendobj\n"), body)

    def read(batches):
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows += [(doc_id, s["page_number"], s["index"], s["text"]) for s in pdf.sections(bytes(content))]
                except pdf.NothingToRead:
                    continue
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "page_number", "section_index", "text"])

    made = documents(spark, sf_dir).withColumn("clean", clean).select("doc_id", F.encode(whole, "ISO-8859-1").alias("content"))
    rows = made.mapInPandas(read, "doc_id long, page_number int, section_index int, text string")
    return rows.select("doc_id", "page_number", "section_index", F.sha2("text", 256).alias("text_sha256"))


@query(f"""
WITH t AS (SELECT conv_id, turn, {D.squeeze('text')} AS t FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE text IS NOT NULL))
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, t) - 1)::INT AS section_index, (turn * 3.5)::DOUBLE AS start_s, sha256(t) AS text_sha256 FROM t WHERE t <> ''""")
def speech_sections(spark, sf_dir):
    """Turns as segments that a recognizer heard."""
    small_batches(spark)
    turns_ = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", "text").distinct()
    heard = turns_.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", T.squeeze(F.col("text")).alias("text")))).alias("heard"))

    def read(batches):
        for batch in batches:
            rows = []
            for conv_id, own in zip(batch["conv_id"], batch["heard"], strict=True):
                found = speech.sections({"text": s["text"], "start": s["turn"] * 3.5 + 0.001, "end": None} for s in own)
                rows += [(conv_id, s["index"], s["start_time_s"], s["text"]) for s in found]
            if rows:
                yield pd.DataFrame(rows, columns=["conv_id", "section_index", "start_s", "text"])

    rows = heard.mapInPandas(read, "conv_id long, section_index int, start_s double, text string")
    return rows.select("conv_id", "section_index", "start_s", F.sha2("text", 256).alias("text_sha256"))


@query(f"SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split({D.newlines(RAGGED)}, chr(10)), lambda x: {D.squeeze('x')}), lambda x: x <> ''), chr(10))) AS text_sha256 FROM documents")
def slide_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(T.clean_slide_text(ragged()), 256).alias("text_sha256"))


@query(f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
h AS (SELECT doc_id, len(s) AS n, list_filter(list_transform(s, lambda x, i: CASE WHEN i % 4 = 2 THEN {D.strip("regexp_replace(x, '#+[" + D.SPACE + "]*$', '')")} ELSE '' END), lambda x: x <> '') AS heads, {D.strip('s[1]')} AS first FROM l)
SELECT doc_id, len(heads)::INT AS headings, ((n + 1) // 4)::INT AS fences, CASE WHEN len(heads) > 0 THEN heads[1] WHEN {D.word_count('first')} BETWEEN 1 AND 15 THEN first ELSE 'none' END AS title FROM h""")
def markdown_counts(spark, sf_dir):
    """Every second line of four is a heading, every fourth stands in a fence."""
    line = lambda x, i: F.when(i % 4 == 1, F.concat(F.lit("### "), x)).when(i % 4 == 2, F.concat(F.lit("```\n"), F.lit("code"), F.lit("\n ~~~"))).otherwise(x)
    own = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    rows = documents(spark, sf_dir).select("doc_id", own.alias("t"))
    # The title's fallback is what text gives: its first line that isn't blank, if that is short.
    return rows.select("doc_id", T.heading_count(F.col("t")).alias("headings"), T.code_block_count(F.col("t")).alias("fences"), T.markdown_title(F.col("t"), F.lit("none")).alias("title"))


def document_json(broken: bool = True) -> F.Column:
    """A document as JSON, whole or, for six of eight, broken in one way."""
    k = F.col("doc_id") if broken else F.lit(0)
    some = F.struct(F.when(k % 8 == 4, -1).otherwise(0).alias("index"), F.when(k % 8 != 5, F.col("text")).alias("text"))
    fields = [F.lit("x").alias(c) for c in ("source_type", "modality", "content_type", "ingestor")]
    return F.to_json(F.struct(
        F.when(k % 8 == 1, F.lit(" ")).otherwise(F.col("doc_id").cast("string")).alias("document_id"), F.col("source").alias("source_path"), *fields, F.when(k % 8 != 3, "m").alias("method"),
        F.array(some).alias("sections"), F.when(k % 8 == 2, "0.9").otherwise("1.0").alias("schema_version"), F.when(k % 8 == 6, "q").alias("zzz"),
    ))


@query("""
SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'document_id must be a non-empty string' WHEN 2 THEN 'schema_version is not supported' WHEN 3 THEN 'missing key: method'
  WHEN 4 THEN 'sections[0]: index must be an integer of at least 0' WHEN 5 THEN 'sections[0]: text must be a string' WHEN 6 THEN 'unknown key: zzz' ELSE '' END AS errors FROM documents""")
def document_errors(spark, sf_dir):
    rows = documents(spark, sf_dir, "doc_id", "text", "source").select("doc_id", document_json().alias("j"))
    return rows.select("doc_id", F.array_join(DOC.document_errors(F.col("j")), "; ").alias("errors"))


@query("SELECT doc_id::VARCHAR AS document_id, 1 AS n_sections, sha256(text) AS text_sha256 FROM documents")
def document_files(spark, sf_dir):
    """All documents written as JSON lines and loaded again."""
    rows = documents(spark, sf_dir, "doc_id", "text", "source").select(F.from_json(document_json(broken=False), DOC.SCHEMA).alias("d")).select("d.*")
    path = storage.new_path(spark, "document-json")
    DOC.save_documents(rows, path, folders=False)
    return DOC.load_documents(spark, path, lines=True).select("document_id", F.size("sections").alias("n_sections"), F.sha2(F.get("sections", F.lit(0))["text"], 256).alias("text_sha256"))


def small_manifests(spark, sf_dir) -> DataFrame:
    """A manifest for each document, of three sources, one of them off."""
    k = F.col("doc_id")
    source = lambda i, priority, split, on: F.concat(F.lit(f'{{"source_id":"s{i}","title":"T","resource_type":"article","local_path":"d'), k.cast("string"), F.lit(f'_{i}.md","topic_bucket_ids":["x"]'), priority, F.lit(split), F.lit(on), F.lit("}"))
    first = F.when(k % 2 == 0, ',"priority":5').otherwise(',"priority":200')
    body = F.concat_ws(",", source(0, first, ',"split":"eval"', ""), source(1, F.lit(""), ',"split":" "', ',"enabled":true'), source(2, F.lit(',"priority":1'), "", ',"enabled":false'))
    json = F.concat(F.lit('{"manifest_version":"1.0","pack_id":"'), k.cast("string"), F.lit('","title":"T","domain":"d","topic_buckets":[{"id":"x","label":"X"}],"sources":['), body, F.lit("]}"))
    return documents(spark, sf_dir, "doc_id").select(F.from_json(json, M.SCHEMA).alias("m")).select("m.*")


ENABLED = "e AS (SELECT doc_id::VARCHAR AS pack_id, 's0' AS source_id, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 200 END AS priority, 'eval' AS split, doc_id FROM documents UNION ALL SELECT doc_id::VARCHAR, 's1', 100, 'unassigned', doc_id FROM documents)"


@query(f"WITH {ENABLED} SELECT pack_id, source_id, priority, split FROM e")
def enabled_sources(spark, sf_dir):
    return M.enabled_sources(small_manifests(spark, sf_dir)).select("pack_id", "source_id", "priority", "split")


@query(f"WITH {ENABLED} SELECT pack_id, source_id, doc_id % 3 = 0 AS skipped, CASE WHEN doc_id % 3 = 0 THEN 'missing file: d' || doc_id || '_' || substr(source_id, 2) || '.md' END AS skip_reason FROM e")
def missing_sources(spark, sf_dir):
    listing = documents(spark, sf_dir, "doc_id").filter("doc_id % 3 > 0").select(F.explode(F.expr("transform(sequence(0, 2), i -> 'd' || doc_id || '_' || i || '.md')")).alias("path"))
    return M.with_existing(M.enabled_sources(small_manifests(spark, sf_dir)), listing).select("pack_id", "source_id", "skipped", "skip_reason")


@query("SELECT 's0' AS source_id, 0 AS place UNION ALL SELECT 's1', 1 UNION ALL SELECT 's2', 2 UNION ALL SELECT source, (row_number() OVER (ORDER BY source) + 2)::INT FROM (SELECT DISTINCT source FROM documents)")
def appended_sources(spark, sf_dir):
    rows = documents(spark, sf_dir, "source").distinct().select(F.col("source").alias("source_id"), F.lit("T").alias("title"), F.lit(7).alias("priority"))
    one = small_manifests(spark, sf_dir).filter("pack_id = '1'")
    path = storage.new_path(spark, "manifest")
    M.write_manifest(M.append_sources(one, rows), path)
    return spark.read.schema(M.SCHEMA).json(path).select(F.posexplode("sources").alias("place", "s")).select("s.source_id", "place")


# Sinks, read back


@query("SELECT source AS playlist_id, sha256('# ' || source || chr(10) || chr(10) || string_agg(pos || '. [' || lang || '](u' || doc_id || ')' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' (' || (n_chars % 50 + 1) || ' min)' END, chr(10) ORDER BY pos)) AS text_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents) GROUP BY source")
def playlist_text(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    seconds = F.when(F.col("doc_id") % 3 != 0, (F.col("n_chars") % 50 + 1) * 60)
    rows = documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars").select(F.col("source").alias("playlist_id"), pos.alias("pos"), F.col("lang").alias("title"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), seconds.alias("duration"))
    return sinks.playlist_index(rows, F.col("playlist_id")).select("playlist_id", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT doc_id, sha256(replace(text, chr(10), chr(10) || chr(10))) AS text_sha256 FROM documents")
def transcript_paragraphs(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(sinks.transcript_text(S.line_sections(F.col("text"))), 256).alias("text_sha256"))


@query(f"SELECT 'FROM base' || chr(10) || 'PARAMETER temperature 0.2' || chr(10) || 'SYSTEM \"\"\"' || {sql_text(PROMPT)} || '\"\"\"' || chr(10) AS text")
def model_template(spark, sf_dir):
    return spark.createDataFrame([(sinks.modelfile("base", PROMPT, {"temperature": "0.2"}),)], "text string")


@query(f"{ROUTED} SELECT task_id, bucket, sha256(source_content) AS content_sha256 FROM routed WHERE bucket IN ('train', 'valid') UNION ALL SELECT task_id, bucket, sha256(source_content) FROM routed WHERE bucket IN ('eval', 'holdout')")
def exported_files(spark, sf_dir):
    """Pairs and references written by bucket and read again."""
    path = storage.new_path(spark, "export")
    export.write_export(routed(spark, sf_dir), path, PROMPT)
    pairs = spark.read.schema("task_id string, messages array<struct<role: string, content: string>>, bucket string").json(f"{path}/pairs")
    refs = spark.read.schema("task_id string, source_content string, bucket string").json(f"{path}/references")
    content = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    return pairs.select("task_id", "bucket", F.sha2(content, 256).alias("content_sha256")).unionByName(refs.select("task_id", "bucket", F.sha2("source_content", 256).alias("content_sha256")))


@query(f"{PACKED} SELECT 'tasks' AS name, true AS there, count(*)::BIGINT AS lines FROM tasks UNION ALL SELECT 'documents', true, count(*)::BIGINT FROM documents UNION ALL SELECT 'index', true, count(DISTINCT source)::BIGINT FROM documents UNION ALL SELECT 'gone', false, 0")
def pack_files(spark, sf_dir):
    """The artifacts of a pack, written, with a report of what is there."""
    path = storage.new_path(spark, "pack")
    docs = documents(spark, sf_dir, "doc_id", "source").select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("document_id"))
    # Chunks are made once: the tasks' ranges are sampled before they are written, and the index counts them again.
    tasks = storage.materialise(packed(spark, sf_dir), "pack-tasks")
    written = sinks.write_pack(small_manifests(spark, sf_dir).filter("pack_id = '1'"), docs, tasks, indexed(spark, sf_dir, tasks), path)
    names = dict(zip(("manifest", "documents", "tasks", "index"), written, strict=True)) | {"gone": f"{path}/gone"}
    report = sinks.artifact_report(spark, {k: v for k, v in names.items() if k != "manifest"})
    return report.select("name", F.col("exists").alias("there"), "lines")


@query(f"{TRIED} SELECT doc_id::VARCHAR AS task_id FROM tried WHERE first <> 'ok' AND NOT mended")
def reject_log(spark, sf_dir):
    """Rejects as they are appended to the log, and never asked again."""
    path = storage.new_path(spark, "enriched")
    enrichment.append(attempts(spark, sf_dir), storage.Run(spark, path, "first"))
    return storage.committed(spark, path, "rejects", "task_id string")


# Provenance, selection, judges


@query(f"""WITH RECURSIVE {D.chunks(LINES, target=60, most=90, least=20, extra=0)}
SELECT doc_id, (final - 1)::INT AS chunk_index, array_to_string(list_sort(list_distinct(list_transform(secs, lambda x: 'h' || x % 3))), ',') AS headings,
       array_to_string(list_sort(list_distinct(list_transform(secs, lambda x: x // 4))), ',') AS pages, list_min(secs)::DOUBLE AS start_s, (list_max(secs) + 1)::DOUBLE AS end_s FROM final""")
def chunk_provenance(spark, sf_dir):
    own = F.transform(F.split("text", "\n"), lambda x, i: S.section(index=i, text=x, heading=F.concat(F.lit("h"), (i % 3).cast("string")), page_number=F.floor(i / 4), start_time_s=i, end_time_s=i + 1))
    rows = chunk_rows(spark, sf_dir, own, chunking.ChunkConfig(60, 90, 20, 0))
    pages = F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ",")
    return rows.select("doc_id", "chunk_index", F.array_join("source_headings", ",").alias("headings"), pages.alias("pages"), F.col("start_time_s").alias("start_s"), F.col("end_time_s").alias("end_s"))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') ORDER BY n_chars DESC, doc_id LIMIT 25)")
def first_rows(spark, sf_dir):
    """The first of the named sources' rows; the limit is the operator."""
    rows = selection.only(documents(spark, sf_dir, "doc_id", "source", "n_chars"), "source", ["src1", "src2"])
    return selection.first(rows, 25, F.desc("n_chars"), "doc_id").select("doc_id")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang FROM documents ORDER BY doc_id % 5, doc_id DESC LIMIT 40)")
def first_lines(spark, sf_dir):
    """The first lines of a folder of JSON files, in the order of files and lines; the limit is the operator."""
    path = storage.new_path(spark, "lines")
    rows = documents(spark, sf_dir, "doc_id", "lang", "text").withColumn("part", F.col("doc_id") % 5)
    # In ranges of the whole order, so a folder is written by as many tasks as its size takes, and its files follow each other.
    order = ["part", F.desc("doc_id")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("part").json(path)
    return selection.first(jsonl.read_jsonl(spark, path, "doc_id long, lang string, text string"), 40, "ord").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 1")
def files_to_fetch(spark, sf_dir):
    """Rows without a whole file: of four, one is there, one is empty, one is partial."""
    rows = documents(spark, sf_dir, "doc_id").withColumn("file", F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    listing = rows.filter("doc_id % 4 > 0").select(F.concat("file", F.when(F.col("doc_id") % 4 == 3, ".part").otherwise("")).alias("path"), F.when(F.col("doc_id") % 4 == 2, 0).otherwise(9).alias("length"))
    every = selection.selected_or_all(rows, "doc_id", rows.filter("false"))
    return selection.missing_files(every, "file", listing).select("doc_id")


@query("SELECT false AS same, true AS same_twice, (SELECT count(*) FROM documents)::BIGINT AS in_flight")
def batch_resume(spark, sf_dir):
    """A batch is resumed if it was submitted for the same ids."""
    tasks = documents(spark, sf_dir, "doc_id").select(F.col("doc_id").cast("string").alias("task_id"), F.lit("p").alias("prompt"))
    path = storage.new_path(spark, "batch")
    answer = lambda _: batches.requests(tasks).select("request_key", F.lit("succeeded").alias("kind"), F.lit("t").alias("text"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    batches.run_batch(tasks, lambda _: "b1", answer, path)
    state = batches.in_flight(spark, path)
    return state.agg(F.lit(batches.same_tasks(state, tasks.filter("task_id <> '1'"))).alias("same"), F.lit(batches.same_tasks(state, tasks.unionByName(tasks))).alias("same_twice"), F.count("*").alias("in_flight"))


@query(f"""{EVALUATED} SELECT task_id, CASE WHEN json_valid AND task_id % 4 = 0 THEN 4 END::INT AS groundedness,
CASE WHEN json_valid THEN CASE task_id % 4 WHEN 0 THEN false ELSE true END END AS failed FROM rows""")
def judged_rows(spark, sf_dir):
    """A judge that times out, rates out of range or says nothing for three of four."""
    k = F.col("task_id") % 4
    said = F.when(k == 0, '{"groundedness":4,"completeness":3,"schema_quality":5}').when(k == 1, '{"groundedness":9,"completeness":3,"schema_quality":5}').when(k == 2, "none")
    rows = evaluation.judge(evaluated(spark, sf_dir), lambda _: F.struct(said.alias("text"), F.when(k == 3, "timeout").alias("error")))
    return rows.select("task_id", "groundedness", F.when(F.col("json_valid"), F.col("judge_error").isNotNull()).alias("failed"))


@query(f"{EVALUATED} SELECT count(*)::BIGINT AS tasks, round(avg(json_valid::INT), 4) AS json_valid_rate, round(avg(schema_valid::INT), 4) AS schema_valid_rate, round(avg(score), 4) AS mean_groundedness FROM rows")
def eval_report(spark, sf_dir):
    path = storage.new_path(spark, "metrics")
    evaluation.write_metrics(evaluation.metrics(evaluated(spark, sf_dir)), path)
    return spark.read.schema("tasks long, json_valid_rate double, schema_valid_rate double, mean_groundedness double").json(path)


def markdown_sql(text: str) -> str:
    own = f"regexp_replace({text}, '{HIDDEN_RE}', chr(10), 'g')"
    for pattern, made in MARKDOWN_RE:
        to = made.replace("$", chr(92)).replace(chr(10), "' || chr(10) || '")
        own = f"regexp_replace({own}, '{pattern}', '{to}', 'g')"
    own = f"regexp_replace(regexp_replace(regexp_replace({own}, '{HIDDEN_RE}', chr(10), 'g'), '{BLOCK_RE}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for entity, char in H.ENTITIES:
        own = f"replace({own}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    lined = f"array_to_string(list_transform(string_split({D.newlines(own)}, chr(10)), lambda x: regexp_replace(x, '[{D.SPACE}]+$', '')), chr(10))"
    return D.strip(rf"regexp_replace({lined}, '\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"SELECT page_id, sha256('# page ' || page_id || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || {markdown_sql('html')} || chr(10)) AS text_sha256, {D.word_count(markdown_sql('html'))} < 80 AS thin FROM pages")
def page_markdown(spark, sf_dir):
    title = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(H.page_document(title, F.col("url"), F.col("html")), 256).alias("text_sha256"), H.is_thin_page(F.col("html")).alias("thin"))
