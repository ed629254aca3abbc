"""Exact dedup by radix partitioning, against SQL and counting."""

from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import radix
from quillspark.llm.oracle import ORACLES
from quillspark.llm.queries import QUERIES


def test_groups_equal_their_sql(spark, messy):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{messy}/documents.parquet/*.parquet'")
    got = Counter(tuple(r) for r in QUERIES["op11_exact_dedup"](spark, messy).collect())
    assert got == Counter(con.sql(ORACLES["op11_exact_dedup"]).fetchall())
    assert max(r[2] for r in got) > 30 and any(r[0] is None for r in got)


@pytest.mark.parametrize("small, heavy", [(16 << 20, 2000), (0, 20), (600, 3)])
def test_any_way_of_joining_gives_the_same_groups(spark, small, heavy):
    """Texts that differ late, of one length, with hot groups and with bytes beyond ASCII."""
    long = "é" * 700
    texts = ["same"] * 90 + [long + "a"] * 40 + [long + "b"] * 20 + [long + "c", long, long + "aa", "", None, "", "sama", "\x00", "\x00\x00", "é", "é"] + [f"u{i}" for i in range(60)]
    rows = [(i // 2 if i < 20 else i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest string, node int").repartition(5)
    got = radix.exact_groups(docs, F.col("doc_id"), F.col("text"), width=2, small=small, heavy=heavy)
    of = defaultdict(list)
    for i, t, *_ in rows:
        of[t or ""].append(i)
    want = Counter((i, t, max(of[t or ""]), len(of[t or ""]), i == max(of[t or ""])) for i, t, *_ in rows)
    assert Counter((r["row"]["doc_id"], r["row"]["text"], *r[1:]) for r in got.collect()) == want


def test_keep_one_leaves_each_text_once(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 7), (None, None, 8), (4, "", 9), (None, "c", 1)], "doc_id long, text string, kept int")
    assert sorted(map(str, (tuple(r) for r in radix.keep_one(docs, F.col("doc_id"), F.col("text")).collect()))) == sorted(["(2, 'a', 6)", "(3, 'b', 7)", "(4, '', 9)", "(None, 'c', 1)"])
