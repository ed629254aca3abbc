"""What is learned rests on whole texts and on all languages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, toxicity


def test_level_is_set_on_whole_texts(spark):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(200)]
    rows = []
    for i in range(240):
        words = list(rng.choice(plain, 60 * toxicity.STRIDE))  # 60 windows, and a passage in one or two of them
        if i % 2:
            at = int(rng.integers(len(words) - 12))
            words[at : at + 12] = ["vrutz" + str(e) for e in rng.choice(["en", "ig", "heit"], 12)]
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(4).cache()
    net = toxicity.fit(docs, F.col("doc_id"), F.col("text"), docs.select(F.col("doc_id").alias("row_id"), "label"), steps=60)
    order = docs.select("doc_id").withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic"))).orderBy("h").collect()
    held = [rows[r["doc_id"]] for r in order][:: toxicity.HELD_FOR_LEVEL]
    p = toxicity.score_texts(net, [t for _, t, _ in held]).clip(1e-6, 1 - 1e-6)
    toxic = np.array([k == 1 for *_, k in held])
    cost = lambda c: 2 * (p[~toxic] >= c).mean() + (p[toxic] < c).mean()
    assert cost(0.5) <= min(cost(c) for c in [*p, *(p + 1e-9)]) + 1e-9


def test_a_rare_language_is_learned(spark):
    rng = np.random.default_rng(4)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(20))
    rows = [(i, make("abcdefgh"), "common") for i in range(3000)] + [(5000 + i, make("stuvwxyz"), "rare") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(docs, F.col("text"), F.col("lang"), F.lit(True), F.col("doc_id"), max_rows=30)
    got = langid.score([make("stuvwxyz"), make("abcdefgh")], *model)
    assert list(got["lang_pred"]) == ["rare", "common"]
    of = model[0].index("rare")
    assert np.ptp(model[1][:-1, of]) > 0  # its n-grams were seen


def test_tasks_without_a_sampled_row(spark):
    rows = [(i, "abc def" if i % 2 else "xyz uvw", "a" if i % 2 else "z") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(16, "doc_id")
    model = langid.fit(docs, F.col("text"), F.col("lang"), F.col("doc_id") > 0, F.col("doc_id"), max_rows=1)
    assert model[0] == ["a", "z"]
    labels = docs.select(F.col("doc_id").alias("row_id"), (F.col("doc_id") % 2).cast("int").alias("label"))
    net = toxicity.fit(docs, F.col("doc_id"), F.col("text"), labels, steps=2)
    assert net is None or len(toxicity.score_texts(net, ["abc", None])) == 2


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    docs = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(docs, F.col("text"), F.col("lang"), F.lit(True), F.col("doc_id"))
