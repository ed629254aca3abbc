"""A corpus from raw documents to shards: five operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of their docs, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, langid, mixing, sharding, simhash
from quillspark.llm.common import whole_row, word_count
from quillspark.llm.queries import small_batches
from quillspark.session import table
from quillspark.storage import materialise

#: A document stays if its language is this sure at least.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, with null text or with an unsure language go."""
    small_batches(spark)
    usable = ~langid.held_out(F.col("doc_id"))
    model = langid.fit(docs, F.col("text"), F.col("lang"), usable, F.col("doc_id"))
    rated = docs.select(whole_row(docs), langid.predict(spark, F.col("text"), model).alias("p"))
    return rated.filter((F.col("p.lang_pred") != langid.UNDETERMINED) & (F.col("p.score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    small_batches(spark)
    return simhash.keep_first(docs, F.col("doc_id"), F.col("text"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    items = table(spark, sf_dir, "benchmark")
    return decontam.keep_clean(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice."""
    mixed = mixing.mix(docs, F.col("doc_id"), F.col("source"), word_count(F.col("text")), F.md5("text"))
    return mixing.apply_mix(mixed)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot."""
    dealt = sharding.shard(docs, F.col("doc_id"), F.col("source"), F.md5("text"))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return dealt.select(*kept, "shard", "slot")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mix),
    ("sharding", shards),
]

#: The first two stages learn a model and hash; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
