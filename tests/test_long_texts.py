"""Texts on which a pattern that starts anew at each place would take hours."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import html as H
from quillspark.functions import text as T
from quillspark.sources import sections as S

SIZE = 1_000_000
TEXTS = {
    "comments": "<!--" * (SIZE // 4), "closed late": "<!--" * (SIZE // 4) + "-->", "openers": "<" * SIZE, "scripts": "<script " * (SIZE // 8), "styles": "<style>" * (SIZE // 7), "headings": "<h1>" * (SIZE // 4),
    "spaces": " " * SIZE + "a", "inner": "a" + " " * SIZE + "b", "lines": "\n" * SIZE + "a", "marks": "# a" + " #" * (SIZE // 2) + "b", "links": '<a href="x">' * (SIZE // 12), "calls": "<tool_call " * (SIZE // 11), "dashes": "a" + "-" * SIZE + "b",
}
FUNCTIONS = {
    "html_lines": H.html_lines, "markdown": H.markdown, "clean_text": T.clean_text, "clean_markdown": T.clean_markdown, "markdown_sections": S.markdown_sections, "heading_count": T.heading_count,
    "sanitize": T.sanitize_response, "overlap_word": T.overlap_word, "vtt": S.vtt_sections, "slug": lambda c: T.slug(c, "x", 40), "sentences": T.sentences, "paragraphs": T.paragraphs,
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "texts")
    spark.createDataFrame(list(TEXTS.items()), "name string, text string").repartition(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("function", FUNCTIONS)
def test_each_is_read_in_linear_time(stored, function):
    run = lambda df: df.select(FUNCTIONS[function](F.col("text")).alias("x")).write.format("noop").mode("overwrite").save()
    run(stored.filter("length(text) < 0"))  # plans and compiles
    began = time.time()
    run(stored)
    assert time.time() - began < 2 * len(TEXTS)


def cell(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("page, lines", [
    ("a<!-- b", ["a"]), ("a<!-- b -->c", ["a", "c"]), ("a<script>x</script >b", ["a", "b"]), ("a<script src='x'", ["a"]), ("a < b <p class=x>c<i>d</i>", ["a d"]), ("a <p class=x>c<i>d</i>", ["a", "cd"]), ("1 < 2", ["1 < 2"]), ("<>a<b", ["a<b"]), ("a>b", ["a>b"]),
    ("<STYLE>x</style>y<BR/>z", ["y", "z"]),
])
def test_tags_and_hidden_parts(spark, page, lines):
    assert cell(spark, H.html_lines(F.lit(page))) == lines


@pytest.mark.parametrize("line, level, text", [
    ("# a", 1, "a"), ("  ## a b ##  ", 2, "a b"), ("####### a", 0, ""), ("#a", 0, ""), ("# #", 1, "#"), ("# ###", 1, "#"), ("#", 0, ""), ("", 0, ""), ("###### x#", 6, "x"), ("#　b", 1, "b"), ("# a #b# #", 1, "a #b#"), ("a # b", 0, ""),
])
def test_headings(spark, line, level, text):
    assert (cell(spark, T.heading_level(F.lit(line))), cell(spark, T.heading_text(F.lit(line)))) == (level, text)


@pytest.mark.parametrize("answer, kept", [
    ("<tool_call>a</tool_call>", "a"), ("x <TOOL_CALL name='<b'> y", "x  y"), ("<tool_calls> a", "<tool_calls> a"), ("a <tool_call", "a <tool_call"), ("1 < 2 <tool_call/>3 > 2", "1 < 2 3 > 2"), ("< / tool_call >z", "z"), ("", ""),
])
def test_tags_of_tool_calls(spark, answer, kept):
    assert cell(spark, T.sanitize_response(F.lit(answer))) == kept


@pytest.mark.parametrize("line, times", [
    ("00:01.500 --> 01:00:02,250 align:start", (1.5, 3602.25)), ("1 00:01.500 --> 00:02.000", (1.5, 2.0)), ("00:01.500-->00:02.000", None), ("00:01 --> 00:02", None), ("a --> b", None), ("", None), ("00:01.5 --> 00:02.000", None),
])
def test_times_of_cues(spark, line, times):
    found = cell(spark, S.cue_times(F.lit(line)))
    assert (found and tuple(found)) == times


def test_elements_become_markdown(spark):
    page = '<head><title>t</title></head><h2> A </h2><p>b <b>c</b> <a class="x" href="u">d</a> <a>e</a></p><ul><li>f<li>g</ul><code>h</code><strong>open<h1>unclosed'
    assert cell(spark, H.markdown(F.lit(page))) == "## A\n\nb **c** [d](u) e\n\n- f\n- g\n`h`open\nunclosed"
