"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import html, urls
from quillspark.llm import decontam, embed_dedup, langid, line_dedup, mixing, radix, reassembly, repair, sharding, simhash, toxicity, url_filter, warc
from quillspark.llm.common import sized_join, word_count
from quillspark.session import small_batches, table
from quillspark.storage import materialise

#: Listed rules of the URL filter: host, beginning of the path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens, block: the URLs of pages whose document is labelled; a page's document is the number that ends its path."""
    block = F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block")
    known = materialise(labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(block), "page-labels")
    number = F.regexp_extract(urls.path(F.col("url")), r"/(\d+)(?:\.[A-Za-z]+)?/?$", 1).try_cast("long")
    held = sized_join(pages.select("page_id", "url", number.alias("doc")), known, ["doc"], "inner", [F.col("page_id"), F.col("url")])
    return held.select(url_filter.tokens(F.col("url")).alias("tokens"), "block")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; pages whose document's label is low quality or toxic teach the rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = url_filter.mine_rules(labelled_urls(pages, table(spark, sf_dir, "labels")))
    judged = url_filter.judge(pages, F.col("url"), URL_RULES, mined)
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "decided_by")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents to the target weights of their sources."""
    docs = table(spark, sf_dir, "documents")
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), F.md5("text").alias("digest")), "document-sizes")
    mixed = mixing.mix(sized, F.col("doc_id"), F.col("source"), F.col("words"), F.col("digest"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark")
    judged = decontam.decontaminate(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"))
    return judged.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards that each hold the mixture of sources."""
    payload = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length("text")).alias("bytes"), F.crc32(payload).alias("crc"))
    rows = docs.select("doc_id", "source", (F.coalesce("bytes", F.lit(0)) + 8).cast("long").alias("size"), F.col("crc").cast("long").alias("crc"))
    dealt = sharding.shard(rows, F.col("doc_id"), F.col("source"), F.concat_ws(":", F.col("crc").cast("string"), F.col("size").cast("string")))
    return dealt.select("row.doc_id", "row.size", F.col("row.crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = simhash.near_duplicates(simhash.fingerprints(docs, F.col("doc_id"), F.col("text")))
    return rows.select(F.col("row_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    small_batches(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of four of five folds."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = langid.held_out(F.col("doc_id"))
    labels = table(spark, sf_dir, "labels").filter(~out & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("row_id")).agg(F.max("toxic").cast("int").alias("label"))
    net = toxicity.fit(docs, F.col("doc_id"), F.col("text"), labels)
    rated = docs.select("doc_id", out.alias("held_out"), toxicity.predict(spark, F.col("text"), net).alias("score"))
    return rated.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    found = embed_dedup.near_duplicates(vectors, F.col("vec_id"), F.col("embedding"), F.col("label"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every page without the boilerplate of its site."""
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), html.html_lines(F.col("html")).alias("lines"))
    cleaned = line_dedup.drop_boilerplate(materialise(pages, "page-lines"), F.col("host"), F.col("lines"))
    text = F.array_join("kept", "\n")
    return cleaned.select("row.page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"), F.sha2(text, 256).alias("text_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four of five folds."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs, F.col("text"), F.col("lang"), ~out, F.col("doc_id"))
    rated = docs.select("doc_id", out.alias("held_out"), langid.predict(spark, F.col("text"), model).alias("p"))
    return rated.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and survivor of every document among those of equal text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    found = radix.exact_groups(docs, F.col("doc_id"), F.col("text"), ["doc_id", "text_sha256"])
    return found.select("row.doc_id", "keep_id", "group_size", "kept", "row.text_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    turns = table(spark, sf_dir, "conversations")
    damaged = repair.damage(turns, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    return repair.summarise(*repair.repair_conversations(damaged))


def op13_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all conversations' turns as they arrive in eight batches."""
    turns = table(spark, sf_dir, "conversations")
    dealt = reassembly.deal(turns, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    events = reassembly.reassemble(dealt)
    return events.select("event", "conv_id", "turn", "batch", F.sha2("payload", 256).alias("sha256"), "n_missing", "n_breaks")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_mixing, op3_decontamination, op4_sharding, op5_simhash, op6_warc, op7_toxicity, op8_embedding_dedup, op9_line_dedup, op10_language_id, op11_exact_dedup, op12_conversation_repair, op13_turn_reassembly)}
