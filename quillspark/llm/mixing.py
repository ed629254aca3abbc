"""Mixing sources to target weights by capped water-filling (DataFrame operations only).

Every source weighs something and may be seen `max_epochs` times at most. The
mix holds `share` times all words. A common level is raised until the words are
dealt: a source gets level x weight, or its cap if that is less, and what a
capped source leaves over lifts the level of the others in proportion to their
weights, again and again until no source is above its cap.

A target is then met with whole repetitions of every document and one more of
the documents that come first in a seeded order, up to the remaining words; the
total is off by half a document at most. Where that order is cut is one key for
each source, so documents stay where they are and are only compared with it.

Edge cases: null text has no words; the null source is a source and comes last;
a source without words gets target 0; documents without words are taken 0 words;
null and repeated ids are ordered by their texts; rows that are equal in all
columns are counted, and if the cut falls among them, as many as belong before
it are repeated; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_ROWS, hashable, seeded_key, sized_join, whole_row
from quillspark.order import ordinal
from quillspark.storage import materialise

WEIGHTS = (5, 2, 1)
#: Hex digits of the seeded key that cut a source into pieces that are ordered apart.
PIECE_DIGITS = 3
#: Equal rows that a task writes out again.
COPIES = 10_000
#: Files of a table with a row for each source, at most.
FILES = 32


def water_level(sources: DataFrame, share: float, max_epochs: float) -> float | None:
    """Words for each unit of weight; None if every source reaches its cap.

    `sources` has source_size and weight. Only sums come to the driver.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, filled = 0.0, -1.0
    while True:
        above = F.col("weight") * F.lit(level) > cap
        row = sources.agg(F.sum(F.when(above, cap)).alias("filled"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        now, free = row["filled"] or 0.0, row["free"] or 0
        if not free:
            return None
        if now == filled:
            return level
        filled, level = now, (total * share - now) / free


def cuts(small: DataFrame, pieces: DataFrame, targets: DataFrame) -> DataFrame:
    """`targets` with the place in its source's order where the further repetition ends.

    Pieces before `cut_piece` are taken, later ones not; in it, rows before the
    edge (`edge_key`, `edge_hash`) are taken, and `edge_taken` of its `edge_n` equal rows.
    """
    by_source = ["no_source", "source"]
    upto = F.sum("piece_size").over(Window.partitionBy(*by_source).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0))
    placed = pieces.withColumn("before", upto - F.col("piece_size")).join(targets.select(*by_source, "rest"), by_source)
    # The first piece that doesn't end before the rest does; if there is none, all of the source is taken.
    crossing = placed.filter((F.col("rest") > 0) & (F.col("before") + F.col("piece_size") > F.col("rest"))).groupBy(*by_source).agg(F.min(F.struct("piece", "before")).alias("c"))
    crossing = materialise(crossing.select(*by_source, F.col("c.piece").alias("piece"), F.col("c.before").alias("before")).join(targets.select(*by_source, "rest"), by_source), "mix-crossing", FILES)
    own = sized_join(small, crossing, [*by_source, "piece"], "inner", [F.col("key")])
    counted = own.groupBy(*by_source, "piece", "key", "hash", "size", "before", "rest").agg(F.count("*").alias("n"))
    words = F.col("size") * F.col("n")
    place = Window.partitionBy(*by_source).orderBy("key", "hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum(words).over(place) - words
    room = F.col("rest") * 2 - F.col("start") * 2 - F.col("size")  # twice the words between the first copy's middle and the end
    copies = F.when(room < 0, 0).when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor(room / (F.greatest("size", F.lit(1)) * 2)) + 1)).cast("long")
    edge = counted.withColumn("start", start).withColumn("taken", copies).filter("taken < n").groupBy(*by_source).agg(F.min(F.struct("key", "hash", "taken", "n")).alias("e"))
    found = crossing.select(*by_source, F.col("piece").alias("cut_piece")).join(edge, by_source, "left")
    edges = [F.col(f"e.{a}").alias(b) for a, b in (("key", "edge_key"), ("hash", "edge_hash"), ("taken", "edge_taken"), ("n", "edge_n"))]
    return targets.join(found.select(*by_source, "cut_piece", *edges), by_source, "left")


def mix(df: DataFrame, row_id: Column, source: Column, size: Column, tie: Column, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Columns row, size, source_size, target, repeats, taken; a row for each of `df`. Rows of equal id have equal texts if `tie` is equal.

    Sizes, keys and hashes of the documents are written once. They are summed up
    by (source, piece of its order), 4096 pieces a source; only the piece where a
    source's order is cut is sorted. The documents themselves meet no other.
    """
    keyed = df.select(
        whole_row(df), size.alias("size"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"),
        seeded_key(seed, row_id, tie).alias("key"), F.xxhash64(*hashable(df)).alias("hash"),
    )
    keyed = keyed.withColumn("piece", F.substring("key", 1, PIECE_DIGITS))
    by_source = ["no_source", "source"]
    small = materialise(keyed.drop("row"), "mix-sizes")

    pieces = materialise(small.groupBy(*by_source, "piece").agg(F.sum("size").alias("piece_size")), "mix-pieces")
    sums = pieces.groupBy(*by_source).agg(F.sum("piece_size").alias("source_size"))
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialise(ordinal(sums, [F.col("no_source"), F.col("source")], "place").withColumn("weight", cycle), "mix-sources", FILES)
    level = water_level(sources, share, max_epochs)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    target = cap if level is None else F.least(cap, F.col("weight") * F.lit(level))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = (
        sources.withColumn("target", target.cast("double")).withColumn("whole", whole.cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("place", "weight")
    )
    plan = materialise(cuts(small, pieces, materialise(targets, "mix-targets", FILES)), "mix-plan", FILES)

    placed = sized_join(keyed, plan, by_source, "inner", [F.col("key")], rows)
    mine, edge = F.struct("key", "hash"), F.struct(F.col("edge_key").alias("key"), F.col("edge_hash").alias("hash"))
    first = F.when(F.col("rest") <= 0, False).when(F.col("cut_piece").isNull() | (F.col("piece") < F.col("cut_piece")), True).when(F.col("piece") > F.col("cut_piece"), False)
    first = first.otherwise(F.col("edge_key").isNull() | (mine < edge))
    kept = ["row", "size", "source_size", "target", "whole"]
    split = F.coalesce((F.col("piece") == F.col("cut_piece")) & (mine == edge) & (F.col("edge_taken") > 0), F.lit(False))
    if plan.filter("edge_taken > 0").isEmpty():
        taken = placed.withColumn("once_more", first.cast("long"))
    else:  # the cut falls among equal rows: one of them stands for all, and is written out again
        one = placed.filter(split).groupBy(*by_source).agg(F.first(F.struct(*kept)).alias("one"), F.first("edge_taken").alias("edge_taken"), F.first("edge_n").alias("edge_n"))
        one = materialise(one.select("one.*", "edge_taken", "edge_n"), "mix-edges", FILES)
        parts = one.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(edge_n - 1) div {COPIES}")))).repartition("part")
        begin = F.col("part") * COPIES
        again = parts.withColumn("copy", F.explode(F.sequence(begin, F.least(begin + COPIES, F.col("edge_n")) - 1)))
        again = again.select(*kept, (F.col("copy") < F.col("edge_taken")).cast("long").alias("once_more"))
        taken = placed.filter(~split).select(*kept, first.cast("long").alias("once_more")).unionByName(again)
    return taken.withColumn("repeats", F.col("whole") + F.col("once_more")).select(
        "row", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken")
    )


def apply_mix(mixed: DataFrame) -> DataFrame:
    """The mixed corpus: every row as often as it is repeated."""
    return mixed.filter("repeats > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy")).select("row.*")
