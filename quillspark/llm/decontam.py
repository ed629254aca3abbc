"""Benchmark decontamination by a prefix-filtered set join (DataFrame operations only).

An item's windows are its runs of `width` consecutive words; an item of fewer
words is one window. A window is the set of its shingles of `SHINGLE` words with
their places (a shorter window is one shingle), and a document holds the window
if it holds all of them in place. So its necessary prefix is one shingle: that
which is rarest in the corpus.

1. One scan tokenises each document and finds, by hash, the places of shingles
   that any window has; the few places found carry the words, which are compared.
2. Shingles are ordered by how often all documents hold them. Places of prefix
   shingles are joined with their windows; the place fixes where a window would
   begin, and windows that would stick out of the document go.
3. What is left is verified: the shingles that together cover the window must
   stand at their places, so every word of the window is compared.

The scan broadcasts the hashes of `scan_shingles` shingles at most; with more, it
is repeated for the next ones, so the benchmark's size decides the number of
scans. No text is shuffled.

Edge cases: null or empty text has no words, and such items no windows; an item
id that is null makes hits but isn't listed; repeated items count once; repeated
documents are judged alike; a document without words isn't contaminated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_ROWS, alnum_words, row_keys, sized_join, whole_row
from quillspark.storage import materialise

WIDTH, SHINGLE = 13, 5
#: Hashes that a scan broadcasts at most, some 30 bytes each.
SCAN_SHINGLES = 2_000_000
#: Files of a table that is made of the benchmark alone, at most.
FILES = 64


def shingle_hash(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + i) for i in range(size)])


def shingle_text(words: str, at: Column, size: Column) -> Column:
    """The shingle's words; none holds a space."""
    return F.array_join(F.slice(words, at + 1, size), " ")


def item_windows(items: DataFrame, item_id: Column, text: Column, width: int) -> DataFrame:
    """window (a digest of its words), words, item: the windows of all items, each once for an item."""
    split = items.select(item_id.cast("string").alias("item"), alnum_words(text).alias("all")).filter("size(all) > 0")
    last = F.greatest(F.size("all") - width, F.lit(0))
    each = split.select("item", "all", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item", F.slice("all", F.col("at") + 1, width).alias("words"))
    return materialise(each.select(F.md5(F.array_join("words", " ")).alias("window"), "words", "item").distinct(), "item-windows", FILES)


def window_shingles(windows: DataFrame, most: int = SHINGLE) -> DataFrame:
    """window, n, offset, size, h, shingle: the shingles of each window."""
    n = F.size("words")
    size = F.least(n, F.lit(most))
    placed = windows.dropDuplicates(["window"]).select("window", "words", n.alias("n"), size.alias("size"), F.explode(F.sequence(F.lit(0), n - size)).alias("offset"))
    h = F.coalesce(*[F.when(F.col("size") == k, shingle_hash("words", F.col("offset"), k)) for k in range(1, most + 1)])
    return materialise(placed.select("window", "n", "offset", "size", h.alias("h"), shingle_text("words", F.col("offset"), F.col("size")).alias("shingle")), "window-shingles", FILES)


def scan(docs: DataFrame, keys: list[Column], text: Column, hashes: DataFrame, sizes: list[int]) -> DataFrame:
    """k1, k2, n_words, pos, size, h, shingle: a row for each document (pos -1) and for each place whose hash is known."""
    tokens = docs.select(*keys, alnum_words(F.coalesce(text, F.lit(""))).alias("words"))
    last = F.greatest(F.size("words") - min(sizes), F.lit(-1))
    # `outer`, as an inner explode would look at the words once more beforehand
    places = tokens.select("k1", "k2", "words", F.size("words").alias("n_words"), F.explode_outer(F.sequence(F.lit(-1), last)).alias("pos"))
    inside = lambda k: F.when((F.col("pos") >= 0) & (F.col("pos") + k <= F.col("n_words")), shingle_hash("words", F.col("pos"), k))
    if len(sizes) == 1:
        hashed = places.withColumns({"size": F.lit(sizes[0]), "h": inside(sizes[0])})
    else:
        each = F.array(*[F.struct(F.lit(k).alias("size"), inside(k).alias("h")) for k in sizes])
        hashed = places.withColumn("s", F.explode_outer(each)).select("k1", "k2", "words", "n_words", "pos", "s.size", "s.h")
        hashed = hashed.filter((F.col("pos") >= 0) | (F.col("size") == sizes[0]))
    known = F.broadcast(hashes.select("h").distinct().withColumn("known", F.lit(True)))
    held = hashed.join(known, "h", "left").filter((F.col("pos") < 0) | F.col("known"))
    return held.select("k1", "k2", "n_words", "pos", "size", "h", F.when(F.col("pos") >= 0, shingle_text("words", F.col("pos"), F.col("size"))).alias("shingle"))


def places_of(docs: DataFrame, keys: list[Column], text: Column, shingles: DataFrame, scan_shingles: int) -> DataFrame:
    """The scans of all documents for all shingles (h, size, shingle), written."""
    known = shingles.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()  # five sizes at most
    scans = max(1, -(-known["n"] // scan_shingles))
    part = F.pmod(F.col("h"), F.lit(scans))
    found = []
    for k in range(scans):  # one after the other, so that one broadcast is held at a time
        seen = scan(docs, keys, text, shingles.filter(part == k), known["sizes"] or [SHINGLE])
        found.append(materialise(seen if k == 0 else seen.filter("pos >= 0"), "shingle-places"))
    return reduce(DataFrame.unionByName, found)


def covered(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted by their beginning."""
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))

    def add(acc: Column, span: Column) -> Column:
        end = F.greatest(acc["end"], span["at"] + span["n"])
        return F.struct((acc["hit"] + end - F.greatest(acc["end"], span["at"])).alias("hit"), end.alias("end"))

    return F.aggregate(spans, start, add, lambda acc: acc["hit"])


def judge(docs: DataFrame, keys: list[Column], text: Column, items: DataFrame, item_id: Column, item_text: Column, width: int, scan_shingles: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, n_words) of all documents, and (k1, k2, hit, items, list) of those that hold windows."""
    members = item_windows(items, item_id, item_text, width)
    placed = window_shingles(members)
    shingles = materialise(placed.select("h", "size", "shingle").distinct(), "known-shingles", FILES)
    seen = places_of(docs, keys, text, shingles, scan_shingles)
    sizes = seen.filter("pos < 0").groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"))
    exact = sized_join(seen.filter("pos >= 0"), shingles, ["h", "size", "shingle"], "left_semi", [F.col("k1"), F.col("pos")], rows)
    places = materialise(exact.groupBy("k1", "k2", "pos", "shingle").agg(F.max("n_words").alias("n_words")), "places")

    counts = places.groupBy("shingle").agg(F.count("*").alias("often"))
    cover = (F.col("offset") % SHINGLE == 0) | (F.col("offset") == F.col("n") - F.col("size"))
    # A window with a shingle that no document holds can't occur; the inner join and the count drop it.
    prefixes = placed.join(counts, "shingle").groupBy("window", "n").agg(
        F.min(F.struct("often", "shingle", "offset")).alias("prefix"), F.count("*").alias("known"), F.max("size").alias("size"),
        F.collect_list(F.when(cover, F.struct("offset", "shingle"))).alias("cover"),
    ).filter("known = n - size + 1").select("window", "n", "prefix.shingle", "prefix.offset", "cover")
    prefixes = materialise(prefixes, "prefixes", FILES)

    at = F.col("pos") - F.col("offset")
    near = sized_join(places, prefixes, ["shingle"], "inner", [F.col("k1"), F.col("pos")], rows).filter((at >= 0) & (at + F.col("n") <= F.col("n_words")))
    needed = near.select("k1", "k2", "window", "n", at.alias("at"), F.size("cover").alias("pieces"), F.explode("cover").alias("c"))
    needed = needed.select("k1", "k2", "window", "n", "at", "pieces", (F.col("at") + F.col("c.offset")).alias("pos"), "c.shingle")
    held = needed.join(places.drop("n_words"), ["k1", "k2", "pos", "shingle"])
    found = materialise(held.groupBy("k1", "k2", "window", "n", "at", "pieces").agg(F.count("*").alias("held")).filter("held = pieces").drop("pieces", "held"), "found-windows")

    spans = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("spans"))
    named = sized_join(found.select("k1", "k2", "window").distinct(), members.filter("item is not null").select("window", "item"), ["window"], "inner", [F.col("k1")], rows)
    ids = named.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    hits = spans.join(ids, ["k1", "k2"], "left").select(
        "k1", "k2", covered(F.col("spans")).cast("long").alias("hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("items"), F.array_join("ids", ",").alias("list"),
    )
    return sizes, hits


def is_contaminated(hit: Column, n_words: Column, least: int) -> Column:
    return (hit > 0) & (hit * least >= n_words)


def decontaminate(docs: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, width: int = WIDTH, least: int = 20, scan_shingles: int = SCAN_SHINGLES, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Columns row, n_words, n_hit, n_items, items_sha256, contaminated; a row for each of `docs`.

    A document is contaminated if it has hit words, and at least one word in `least` is hit.
    """
    keys = row_keys(doc_id, text)
    sizes, hits = judge(docs, keys, text, items, item_id, item_text, width, scan_shingles, rows)
    hit = F.coalesce("hit", F.lit(0).cast("long"))
    judged = sizes.join(hits, ["k1", "k2"], "left").select(
        "k1", "k2", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.coalesce("items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"), is_contaminated(hit, F.col("n_words"), least).alias("contaminated"),
    )
    return docs.select(whole_row(docs), *keys).join(judged, ["k1", "k2"]).drop("k1", "k2")


def keep_clean(docs: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column, width: int = WIDTH, least: int = 20, scan_shingles: int = SCAN_SHINGLES, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of `docs` that aren't contaminated; texts stay where they are while the contaminated can be broadcast."""
    keys = row_keys(doc_id, text)
    sizes, hits = judge(docs, keys, text, items, item_id, item_text, width, scan_shingles, rows)
    bad = sizes.join(hits, ["k1", "k2"]).filter(is_contaminated(F.col("hit"), F.col("n_words"), least)).select("k1", "k2")
    left = docs.select(whole_row(docs), *keys)
    return sized_join(left, materialise(bad, "contaminated"), ["k1", "k2"], "left_anti", [F.col("k1")], rows).select("row.*")
