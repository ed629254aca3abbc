"""Word-budgeted chunks of documents, with provenance and overlap.

A document is an array of sections. Long sections are cut into parts at
paragraphs, then sentences, then words; parts are packed into chunks in order;
chunks that are too small join a neighbour or go; chunks cut from long sections
begin with the last words of the one before.

All of it is expressions over a document's arrays, in the JVM: three folds, of
pieces to parts, of parts to packs and of packs to chunks. What a fold has open
holds no more than a part, a pack or two of them; what is done is appended once.
Nothing is shuffled, and documents don't depend on each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.text import let

SECTION = (
    "struct<index: int, text: string, raw_text: string, heading: string, page_number: int, slide_number: int, "
    "start_time_s: double, end_time_s: double, speaker: string, confidence: double, extraction_method: string>"
)
SINGLE, MERGED, SPLIT = "single_section", "merged_small_sections", "split_oversized_section"
#: What a chunk says of the sections it comes from.
ORIGIN = ("heading", "page_number", "slide_number", "start_time_s", "end_time_s")
ORIGINS = "struct<heading: string, page_number: int, slide_number: int, start_time_s: double, end_time_s: double>"
#: A piece of a section: `sec` counts sections, `kind` is how it may be joined, `run` counts the sentences that were cut into words.
PIECE = f"struct<sec: int, index: int, text: string, n: int, kind: string, run: int, origin: {ORIGINS}>"
PART = f"struct<sec: int, index: int, text: string, n: int, origin: {ORIGINS}, cut: boolean, opens: boolean>"
#: A pack of parts, and a chunk made of packs.
PACK = f"struct<n: int, sections: array<int>, reason: string, texts: array<string>, origins: array<{ORIGINS}>>"
WHOLE, TEXT, WORD = "whole", "text", "word"
Measure = Callable[[Column], Column]


def each(size: Callable[[Column], Column]) -> Measure:
    """A measure of arrays of texts from an expression for one text."""
    return lambda texts: F.transform(texts, size)


def counter(size: Callable[[str], int]) -> Measure:
    """A measure of arrays of texts from a Python function for one text (a tokenizer's count, say), by Arrow batches."""

    @F.pandas_udf("array<int>")
    def measured(batch: pd.Series) -> pd.Series:
        return pd.Series([None if texts is None else [None if t is None else size(t) for t in texts] for texts in batch])

    return measured.asNondeterministic()  # else projects are merged, and a Python function can't stand inside another expression's lambda


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in words, or in the unit that `size` measures: array of texts to array of int.

    A long sentence is cut after words whose own sizes add up to `most` at most,
    so that no part holds more than `most` unless a single word does; overlap is
    always in words.
    """

    target: int = 450
    most: int = 700
    least: int = 120
    overlap: int = 60
    keep_boundaries: bool = False
    size: Measure | None = None

    def __post_init__(self) -> None:
        if self.target <= 0 or self.most < self.target or self.least < 0 or self.overlap < 0:
            raise ValueError("sizes must satisfy 0 < target <= most, least >= 0 and overlap >= 0")


def none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def changed(x: Column, **new: Column) -> Column:
    return F.struct(*[new.get(c, x[c]).alias(c) for c in ("sec", "index", "text", "n", "kind", "run", "origin")])


def sized(out: DataFrame, size: Measure) -> DataFrame:
    """Pieces `_p` with their sizes where these aren't known yet."""
    measured = out.withColumn("_n", size(F.transform("_p", lambda x: F.when(x["n"].isNull(), x["text"]))))
    return measured.withColumn("_p", F.zip_with("_p", "_n", lambda x, n: changed(x, n=F.coalesce(x["n"], n).cast("int")))).drop("_n")


def counted(out: DataFrame) -> DataFrame:
    return out.withColumn("_p", F.transform("_p", lambda x: changed(x, n=F.coalesce(x["n"], T.word_count(x["text"])).cast("int"))))


def cut_where_long(pieces: str, most: int, cut: Callable[[Column], Column], kind: str) -> Column:
    """Pieces of more than `most` units as what `cut` makes of their text, which isn't sized."""

    def smaller(x: Column, i: Column) -> Column:
        parts = F.transform(cut(x["text"]), lambda t: changed(x, text=t, n=F.lit(None).cast("int"), kind=F.lit(kind), run=i.cast("int")))
        return F.when(x["n"] > most, parts).otherwise(F.array(x))

    return F.flatten(F.transform(pieces, smaller))


def parts(pieces: str, most: int) -> Column:
    """Parts of `most` units at most: pieces of a section joined in order; runs of words stand alone."""
    start = F.struct(none(PIECE).alias("done"), F.lit(None).cast(f"struct<n: int, texts: array<string>, last: {PIECE}>").alias("open"))

    def closed(acc: Column) -> Column:
        now = acc["open"]
        text = F.when(now["last"]["kind"] == WORD, F.array_join(now["texts"], " ")).otherwise(F.array_join(now["texts"], "\n\n"))
        return F.when(now.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(changed(now["last"], text=text, n=now["n"]))))

    def add(acc: Column, x: Column) -> Column:
        now, last = acc["open"], acc["open"]["last"]
        alike = (x["kind"] != WHOLE) & (last["kind"] == x["kind"]) & (last["sec"] == x["sec"]) & ((x["kind"] != WORD) | (last["run"] == x["run"]))
        joins = F.coalesce(alike & ((now["n"] + x["n"] <= most) | (now["n"] == 0)), F.lit(False))
        n = F.when(joins, now["n"] + x["n"]).otherwise(x["n"])
        texts = F.when(joins, F.concat(now["texts"], F.array(x["text"]))).otherwise(F.array(x["text"]))
        return F.struct(F.when(joins, acc["done"]).otherwise(closed(acc)).alias("done"), F.struct(n.alias("n"), texts.alias("texts"), x.alias("last")).alias("open"))

    return F.aggregate(pieces, start, add, closed)


def beside_others(made: str) -> Column:
    """Parts with text, and whether their section was cut and begins with them."""

    nothing = F.array(F.lit(None).cast("int"))

    def placed(all_: Column) -> Column:
        whose = F.transform(all_, lambda x: x["sec"])
        before = F.slice(F.concat(nothing, whose), F.lit(1), F.size(all_))
        after = F.concat(F.slice(whose, F.lit(2), F.greatest(F.size(all_), F.lit(1))), F.slice(nothing, F.lit(1), F.size(all_)))
        pairs = F.zip_with(all_, before, lambda x, b: F.struct(x.alias("x"), (~b.eqNullSafe(x["sec"])).alias("opens")))
        zipped = F.zip_with(pairs, after, lambda z, a: F.struct(z["x"].alias("x"), z["opens"].alias("opens"), (~a.eqNullSafe(z["x"]["sec"])).alias("ends")))
        row = lambda z: F.struct(
            *[z["x"][c].alias(c) for c in ("sec", "index")], T.strip(z["x"]["text"]).alias("text"), *[z["x"][c].alias(c) for c in ("n", "origin")],
            (~z["opens"] | ~z["ends"]).alias("cut"), z["opens"].alias("opens"),
        )
        return F.filter(F.transform(zipped, row), lambda x: x["n"] > 0)

    return let(F.col(made), placed)


def packs(made: str, config: ChunkConfig) -> Column:
    """Parts packed in order: a pack ends at `target` units, or before `most` would be exceeded."""
    start = F.struct(none(PACK).alias("done"), F.lit(None).cast(PACK).alias("open"))
    done = lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def extended(now: Column, x: Column) -> Column:
        known = F.when(F.array_contains(now["sections"], x["index"]), now["sections"]).otherwise(F.concat(now["sections"], F.array(x["index"])))
        sections = F.coalesce(known, F.array(x["index"]))
        reason = F.when(x["cut"], SPLIT).when(F.size(sections) > 1, MERGED).otherwise(SINGLE)
        return F.struct(
            (F.coalesce(now["n"], F.lit(0)) + x["n"]).alias("n"), sections.alias("sections"), reason.alias("reason"),
            F.coalesce(F.concat(now["texts"], F.array(x["text"])), F.array(x["text"])).alias("texts"), F.coalesce(F.concat(now["origins"], F.array(x["origin"])), F.array(x["origin"])).alias("origins"),
        )

    def add(acc: Column, x: Column) -> Column:
        full = acc["open"]["n"] + x["n"] > config.most
        if config.keep_boundaries:
            full = full | (x["opens"] & (F.element_at(acc["open"]["sections"], -1) != x["index"]))
        fresh = F.coalesce(full, F.lit(True))
        now = F.when(~fresh, acc["open"])
        return let(F.struct(F.when(fresh, done(acc)).otherwise(acc["done"]).alias("done"), extended(now, x).alias("open")), lambda a: F.struct(F.when(a["open"]["n"] >= config.target, done(a)).otherwise(a["done"]).alias("done"), F.when(a["open"]["n"] < config.target, a["open"]).alias("open")))

    return F.aggregate(made, start, add, done)


def joined(one: Column, two: Column) -> Column:
    """Two packs as one."""
    sections = F.array_union(one["sections"], two["sections"])
    reason = F.when(F.size(sections) > 1, MERGED).when(two["reason"] == SPLIT, SPLIT).otherwise(one["reason"])
    return F.struct((one["n"] + two["n"]).alias("n"), sections.alias("sections"), reason.alias("reason"), F.concat(one["texts"], two["texts"]).alias("texts"), F.concat(one["origins"], two["origins"]).alias("origins"))


def without_small(made: str, config: ChunkConfig) -> Column:
    """Packs of `least` units: a small one goes into the next, else into the last that was kept, else it is dropped; if none is left, the largest stays."""
    if not config.least:
        return F.col(made)
    start = F.struct(none(PACK).alias("kept"), F.lit(None).cast(PACK).alias("carried"), F.lit(None).cast(PACK).alias("largest"))

    def add(acc: Column, x: Column) -> Column:
        def judged(own: Column) -> Column:
            last = F.try_element_at(acc["kept"], F.lit(-1))
            large = own["n"] >= config.least
            carries = ~large & F.coalesce(own["n"] + x["next"] <= config.most, F.lit(False))
            back = ~large & ~carries & (F.size(acc["kept"]) > 0) & F.coalesce(last["n"] + own["n"] <= config.most, F.lit(False))
            kept = F.when(large, F.concat(acc["kept"], F.array(own))).when(back, F.concat(F.slice(acc["kept"], F.lit(1), F.size(acc["kept"]) - 1), F.array(joined(last, own)))).otherwise(acc["kept"])
            largest = F.when(F.coalesce(own["n"] <= acc["largest"]["n"], F.lit(False)), acc["largest"]).otherwise(own)
            return F.struct(kept.alias("kept"), F.when(carries, own).alias("carried"), largest.alias("largest"))

        return let(F.when(acc["carried"].isNull(), x["pack"]).otherwise(joined(acc["carried"], x["pack"])), judged)

    def folded(all_: Column) -> Column:
        sizes = F.transform(all_, lambda p: p["n"])
        after = F.concat(F.slice(sizes, F.lit(2), F.greatest(F.size(all_), F.lit(1))), F.array(F.lit(None).cast("int")))
        rows = F.zip_with(all_, F.slice(after, F.lit(1), F.size(all_)), lambda p, n: F.struct(p.alias("pack"), n.alias("next")))
        end = F.aggregate(rows, start, add, lambda acc: F.when(F.size(acc["kept"]) > 0, acc["kept"]).otherwise(F.array(acc["largest"])))
        return F.when(F.size(all_) < 2, all_).otherwise(end)

    return let(F.col(made), folded)


def chunk_structs(made: str, config: ChunkConfig) -> Column:
    """Packs as chunks, with the last words of the one before where both were cut from long sections."""

    def of_bodies(bodies: Column) -> Column:
        tails = F.transform(bodies, lambda b: F.when(F.lit(config.overlap > 0) & (b["reason"] == SPLIT), b["tail"]))
        before = F.slice(F.concat(F.array(F.lit(None).cast("string")), tails), F.lit(1), F.size(bodies))
        texts = F.zip_with(bodies, before, lambda b, t: F.struct(b.alias("b"), F.when((b["reason"] == SPLIT) & t.isNotNull(), F.concat(t, F.lit("\n\n"), b["body"])).otherwise(b["body"]).alias("text")))
        return F.transform(texts, chunk)

    def chunk(x: Column, i: Column) -> Column:
        def every(field: str) -> Column:
            return F.array_sort(F.array_distinct(F.filter(F.transform(x["b"]["origins"], lambda o: o[field]), lambda v: v.isNotNull())))

        starts, ends = every("start_time_s"), every("end_time_s")
        timed = (F.size(starts) > 0) & (F.size(ends) > 0)
        return F.struct(
            i.cast("int").alias("chunk_index"), x["text"].alias("text"), T.word_count(x["text"]).alias("word_count"), F.array_sort(x["b"]["sections"]).alias("source_section_indexes"),
            F.filter(every("heading"), lambda h: h != "").alias("source_headings"), every("page_number").alias("source_pages"), every("slide_number").alias("source_slides"),
            F.when(timed, F.get(starts, F.lit(0))).alias("start_time_s"), F.when(timed, F.get(ends, F.size(ends) - 1)).alias("end_time_s"), x["b"]["reason"].alias("split_reason"),
        )

    def body(p: Column) -> Column:
        return let(F.array_join(p["texts"], "\n\n"), lambda t: F.struct(t.alias("body"), p["sections"], p["origins"], p["reason"], F.when(p["reason"] == SPLIT, last_words(t)).alias("tail")))

    def last_words(t: Column) -> Column:
        return let(T.words(t), lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - max(config.overlap, 1) + 1, F.lit(1)), F.lit(max(config.overlap, 1))), " "))

    return let(F.transform(made, body), of_bodies)


def with_chunks(docs: DataFrame, sections: str, config: ChunkConfig) -> DataFrame:
    """`docs` with the array `_chunks`; documents without sections have none."""
    size = (lambda out: sized(out, config.size)) if config.size else counted
    origin = lambda s: F.struct(*[s[c].alias(c) for c in ORIGIN])
    piece = lambda s, i: F.struct(i.cast("int").alias("sec"), s["index"].alias("index"), F.coalesce(s["text"], F.lit("")).alias("text"), F.lit(None).cast("int").alias("n"), F.lit(WHOLE).alias("kind"), F.lit(0).alias("run"), origin(s).alias("origin"))
    out = size(docs.withColumn("_p", F.transform(F.coalesce(sections, none(SECTION)), piece)))
    for cut, kind in ((T.paragraphs, TEXT), (T.sentences, TEXT), (T.words, WORD)):
        out = size(out.withColumn("_p", cut_where_long("_p", config.most, cut, kind)))
    out = out.withColumn("_p", parts("_p", config.most)).withColumn("_p", beside_others("_p"))
    return out.withColumn("_p", packs("_p", config)).withColumn("_p", without_small("_p", config)).withColumn("_chunks", chunk_structs("_p", config)).drop("_p")


def chunk_documents(docs: DataFrame, sections: str = "sections", config: ChunkConfig | None = None) -> DataFrame:
    """A row for each chunk: all columns of `docs` but the sections, and those of the chunk.

    `explode` would have its input filtered by size first, which chunks twice.
    """
    keep = [c for c in docs.columns if c != sections]
    made = with_chunks(docs, sections, config or ChunkConfig())
    return made.select(*keep, F.explode_outer("_chunks").alias("chunk")).filter("chunk is not null").select(*keep, "chunk.*")
