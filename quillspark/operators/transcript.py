"""Merging of timed transcript segments.

Segments of a document are folded in order: a segment opens a new one if the gap
before it, the words with it or the duration with it exceed their limits;
otherwise its text is added without the words that the seam repeats. The fold
depends on the text so far, so it runs as an Arrow UDF over arrays of sections.
`gap_sessions` is the variant that only looks at gaps; it is a window.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.chunking import SECTION
from quillspark.sources.sections import section
from quillspark.storage import materialise

EMPTY = {f.split(": ")[0]: None for f in SECTION[len("struct<") : -1].split(", ")}


EDGES = re.compile(r"^\W+|\W+$")


@lru_cache(maxsize=1 << 16)
def bare(word: str) -> str:
    """A word as it is compared at a seam."""
    own = word.lower()
    return own if own.isalnum() else EDGES.sub("", own)


def seam(before: list[str], after: list[str], most: int = 30) -> int:
    """How many words are repeated where `after` follows `before`."""
    a, b = [bare(w) for w in before[-most:]], [bare(w) for w in after[:most]]
    if not a or a[-1] not in b:
        return 0
    return next((n for n in range(min(len(a), len(b)), 0, -1) if b[n - 1] == a[-1] and a[-n:] == b[:n]), 0)


def appended(before: str, after: str) -> str:
    """`after` added to `before`, unless it is in there, without the seam's repeated words."""
    before, after = before.strip(), after.strip()
    if not before or not after:
        return before or after
    flat = lambda t: " ".join(t.lower().split())
    if flat(after) in flat(before):
        return before
    words = after.split()
    n = seam(before.split(), words)
    rest = " ".join(words[n:]) if n else after
    return f"{before} {rest}" if rest else before


def joined_to(last: list, text: str, start: float | None, end: float | None, most_words: int, most_seconds: float, most_gap: float) -> list | None:
    """The segment `last` (text, start, end) with the next one, or None if that opens a new one."""
    before, began, ended = last
    gap = start - ended if start is not None and ended is not None else 0.0
    length = end - began if end is not None and began is not None else 0.0
    if gap > most_gap or length > most_seconds:
        return None
    both = appended(before, text)
    return [both, began, end] if len(both.split()) <= most_words else None


def merge_runs(texts: list, starts: list, ends: list, most_words: int = 100, most_seconds: float = 60.0, most_gap: float = 8.0) -> list[list]:
    """[text, start, end] of the merged segments of one document. Segments without a start keep their text."""
    merged: list[list] = []
    for text, start, end in zip(texts, starts, ends, strict=True):
        text = (text or "").strip()
        if not text:
            continue
        both = joined_to(merged[-1], text, start, end, most_words, most_seconds, most_gap) if merged else None
        if both:
            merged[-1] = both
        else:
            merged.append([text, start, end])
    return merged


def merge_segments(segments: list[dict], most_words: int = 100, most_seconds: float = 60.0, most_gap: float = 8.0) -> list[dict]:
    """Merged sections of one document's segments."""
    columns = ([s[k] for s in segments] for k in ("text", "start_time_s", "end_time_s"))
    rows = merge_runs(*columns, most_words, most_seconds, most_gap)
    return [EMPTY | {"index": i, "text": t, "raw_text": t, "start_time_s": a, "end_time_s": b, "extraction_method": "transcript_merge"} for i, (t, a, b) in enumerate(rows)]


def merge_transcript(sections: Column, most_words: int = 100, most_seconds: float = 60.0, most_gap: float = 8.0) -> Column:
    """Array of merged sections of an array of timed sections.

    Only texts and times go to Python and back; the rest of a section is made here.
    """

    @F.pandas_udf("array<struct<text: string, start: double, end: double>>")
    def run(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        times = lambda values: [None if v is None or v != v else float(v) for v in values]
        rows = zip(texts, starts, ends, strict=True)
        return pd.Series([[] if t is None else merge_runs(list(t), times(a), times(b), most_words, most_seconds, most_gap) for t, a, b in rows], dtype=object)

    part = lambda k: F.transform(sections, lambda s: s[k])
    merged = run(part("text"), part("start_time_s").cast("array<double>"), part("end_time_s").cast("array<double>"))
    method = F.lit("transcript_merge")
    return F.transform(merged, lambda m, i: section(index=i, text=m["text"], raw_text=m["text"], start_time_s=m["start"], end_time_s=m["end"], extraction_method=method))


def captions_or_speech(captions: DataFrame, speech: DataFrame) -> DataFrame:
    """Sections (video_id, sections) from captions, and from speech for videos that have none."""
    good = captions.filter(F.size("sections") > 0).withColumn("origin", F.lit("captions"))
    rest = speech.join(good.select("video_id"), "video_id", "left_anti").withColumn("origin", F.lit("speech"))
    return good.unionByName(rest)


def gap_sessions(rows: DataFrame, by: str, order: list[str], start: Column, end: Column, most_gap: float) -> DataFrame:
    """`rows` with `session`, from 0: a new one begins after each gap of more than `most_gap`.

    Rows are dealt to ranges of the whole order, so a key that holds many of them
    is cut; sessions are counted in each range, and what the ranges before hold of
    a key is added from one row for each key and range.
    """
    dealt = rows.withColumns({"_start": start, "_end": end}).repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, "session-rows")
    own = Window.partitionBy("_range", by).orderBy(*order)
    opens = F.coalesce((F.col("_start") - F.lag("_end").over(own) > most_gap).cast("int"), F.lit(0))
    counted = dealt.withColumn("_opens", opens).withColumn("_session", F.sum("_opens").over(own))
    place = F.struct(*order)
    edges = counted.groupBy("_range", by).agg(F.min_by("_start", place).alias("_first"), F.max_by("_end", place).alias("_last"), F.sum("_opens").alias("_within"))
    before = Window.partitionBy(by).orderBy("_range")
    between = F.coalesce((F.col("_first") - F.lag("_last").over(before) > most_gap).cast("int"), F.lit(0))
    edges = edges.withColumn("_between", between).withColumn("_base", F.sum(F.col("_within") + F.col("_between")).over(before) - F.col("_within"))
    known = edges.select(F.col("_range").alias("_r"), F.col(by).alias("_by"), "_base")
    joined = counted.join(known, (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.withColumn("session", F.col("_session") + F.col("_base")).drop("_r", "_by", "_base", "_session", "_opens", "_range", "_start", "_end")
