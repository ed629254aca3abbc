"""Chunks: examples of each branch, and properties that hold for any document."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking
from quillspark.operators.chunking import MERGED, SECTION, SINGLE, SPLIT, ChunkConfig, chunk_documents
from quillspark.plans import catalogue
from quillspark.sources.sections import line_sections

FIELDS = [f.split(": ")[0] for f in SECTION[len("struct<") : -1].split(", ")]


def chunk_all(spark, documents, config):
    """Chunks of each document, a list of sections."""
    rows = [(i, [tuple(s.get(f) for f in FIELDS) for s in own]) for i, own in enumerate(documents)]
    got = chunk_documents(spark.createDataFrame(rows, f"doc int, sections array<{SECTION}>"), config=config).orderBy("doc", "chunk_index").collect()
    return [[r.asDict() for r in got if r["doc"] == i] for i in range(len(documents))]


def chunk_sections(spark, own, config):
    return chunk_all(spark, [own], config)[0]


def sections(*sizes, **more):
    return [{"index": i, "text": " ".join(f"w{i}x{k}" for k in range(n))} | {key: value[i] for key, value in more.items()} for i, n in enumerate(sizes)]


def shape(chunks):
    return [(c["word_count"], c["source_section_indexes"], c["split_reason"]) for c in chunks]


def test_long_section_is_cut_with_overlap(spark):
    got = chunk_sections(spark, sections(260), ChunkConfig(80, 100, 10, 15))
    assert shape(got) == [(100, [0], SPLIT), (115, [0], SPLIT), (75, [0], SPLIT)]
    assert got[1]["text"].split()[:15] == got[0]["text"].split()[-15:]


def test_short_sections_are_merged(spark):
    assert shape(chunk_sections(spark, sections(10, 10, 10), ChunkConfig(40, 120, 5, 0))) == [(30, [0, 1, 2], MERGED)]


def test_provenance_is_gathered(spark):
    own = sections(20, 20, heading=["B", "A"], start_time_s=[0.0, 5.5], end_time_s=[5.0, 15.0], page_number=[2, 2])
    (got,) = chunk_sections(spark, own, ChunkConfig(100, 200, 5, 0))
    assert (got["source_headings"], got["source_pages"], got["start_time_s"], got["end_time_s"]) == (["A", "B"], [2], 0.0, 15.0)


def test_small_last_chunk_joins_the_one_before(spark):
    assert shape(chunk_sections(spark, sections(50, 3), ChunkConfig(50, 120, 20, 0))) == [(53, [0, 1], MERGED)]


def test_sole_small_chunk_stays(spark):
    assert shape(chunk_sections(spark, sections(5), ChunkConfig(40, 80, 20, 0))) == [(5, [0], SINGLE)]


def test_small_chunk_that_fits_nowhere_goes(spark):
    assert shape(chunk_sections(spark, sections(100, 10), ChunkConfig(100, 105, 20, 0))) == [(100, [0], SINGLE)]


def test_small_chunks_join_forward_at_boundaries(spark):
    got = chunk_sections(spark, sections(5, 30, 4), ChunkConfig(30, 100, 25, 0, keep_boundaries=True))
    assert shape(got) == [(39, [0, 1, 2], MERGED)]


def test_largest_stays_if_all_would_go(spark):
    got = chunk_sections(spark, sections(10, 12, 11), ChunkConfig(10, 15, 14, 0))
    assert shape(got) == [(12, [1], SINGLE)]


@pytest.mark.parametrize("sizes", [(0, 10, 1, 0), (10, 5, 1, 0), (10, 20, -1, 0), (10, 20, 1, -1)])
def test_bad_sizes(sizes):
    with pytest.raises(ValueError):
        ChunkConfig(*sizes)


@pytest.mark.parametrize("seed", range(4))
def test_properties(spark, seed):
    rng = random.Random(seed)
    target = rng.randint(5, 40)
    config = ChunkConfig(target, target + rng.randint(0, 30), rng.randint(0, 30), rng.randint(0, 8), rng.random() < 0.5)
    documents = [sections(*[rng.randint(0, 70) for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    plain = chunk_all(spark, documents, ChunkConfig(config.target, config.most, config.least, 0, config.keep_boundaries))
    for own, got, bare in zip(documents, chunk_all(spark, documents, config), plain, strict=True):
        every = [w for s in own for w in s["text"].split()]
        rest = iter(every)
        assert all(w in rest for c in bare for w in c["text"].split())  # a subsequence
        assert [c["chunk_index"] for c in got] == list(range(len(got)))
        assert all(c["word_count"] <= config.most + config.overlap for c in got)
        assert all(c["word_count"] >= config.least for c in bare) or len(bare) == 1
        assert bool(got) == bool(every)


def test_units_of_any_kind(spark):
    """An expression and a Python function that count the same give the same chunks."""
    own = [{"index": 0, "text": "A long one. " * 30 + "\n\n" + "x" * 300 + " " + "word " * 40}, {"index": 1, "text": "short"}, {"index": 2, "text": None}]
    made = [chunk_sections(spark, own, ChunkConfig(40, 60, 0, 0, size=size)) for size in (chunking.each(F.length), chunking.counter(len))]
    assert made[0] == made[1] and len(made[0]) > 5
    assert all(len(p.replace(" ", "")) <= 60 or p == "x" * 300 for c in made[0] for p in c["text"].split("\n\n"))
    assert [w for c in made[0] for w in c["text"].split()] == (own[0]["text"] + " short").split()


def test_words_that_are_too_long_stand_alone(spark):
    got = chunk_sections(spark, [{"index": 4, "text": "one two three four five six. Seven eight.\n\nNine."}], ChunkConfig(2, 4, 0, 0))
    assert [(c["text"], c["split_reason"]) for c in got] == [("one two three four", SPLIT), ("five six.", SPLIT), ("Seven eight.\n\nNine.", SPLIT)]


@pytest.mark.parametrize("name", ["chunk_documents", "chunk_lines", "chunk_overlap", "chunk_provenance", "task_rows", "pack_sources", "pack_totals", "audit_chunks"])
def test_chunks_stay_in_the_jvm(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_rows_of_chunks(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e f"), (2, None), (3, "")], "id long, text string")
    got = chunk_documents(docs.select("id", line_sections(F.col("text")).alias("sections")), config=ChunkConfig(3, 5, 0, 0)).collect()
    assert [(r["id"], r["chunk_index"], r["text"]) for r in got] == [(1, 0, "a b c"), (1, 1, "d e f")]
