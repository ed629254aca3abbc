"""The pipeline's stages, each against its own rule on its own input."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from quillspark.llm import decontam, langid


def test_stages_in_order(spark, messy):
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, messy)
        path = f"{messy}/out_{name}"
        out.write.mode("overwrite").parquet(path)
        seen[name] = (docs, spark.read.parquet(path))
        docs = seen[name][1]
        if name != "sharding":
            assert docs.columns == columns
    before, after = seen["language_id"]
    letters = {r["doc_id"] for r in before.filter(F.col("text").rlike(r"\p{L}")).collect()}
    assert {403, 404, 405, 406}.isdisjoint({r["doc_id"] for r in after.collect()})
    assert len({r["doc_id"] for r in after.collect()}) > 0.95 * len(letters)

    before, after = seen["simhash_near_dedup"]
    ids = [r["doc_id"] for r in after.collect()]
    assert {i for i, n in Counter(ids).items() if n > 1} <= {11} and 1 in ids and 200 not in ids  # 11 stands in two groups

    before, after = seen["benchmark_decontamination"]
    judged = decontam.decontaminate(before, F.col("doc_id"), F.col("text"), spark.read.parquet(f"{messy}/benchmark.parquet"), F.col("item_id"), F.col("text"))
    good = Counter(r["doc_id"] for r in judged.filter("not contaminated").select("row.doc_id").collect())
    assert Counter(r["doc_id"] for r in after.collect()) == good

    before, after = seen["source_mixing"]
    times = Counter(r["doc_id"] for r in after.collect())
    assert max(n for i, n in times.items() if i != 11) <= 2 and set(times) <= {r["doc_id"] for r in before.collect()}

    before, after = seen["sharding"]
    assert after.columns == [c for c in columns if c != "shard"] + ["shard", "slot"]
    counts = Counter(r["shard"] for r in after.collect())
    assert after.count() == before.count() and max(counts.values()) - min(counts.values()) <= 1


def test_run_over_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("text"), F.col("lang"), F.lit(True), F.col("doc_id"))
    assert docs.select(langid.predict(spark, F.col("text"), model).alias("p")).select("p.*").collect()[0].asDict() == {"lang_pred": "und", "score": 0.0}
