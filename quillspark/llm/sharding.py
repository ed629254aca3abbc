"""Proportional stratified interleaving into shards (DataFrame operations only).

Rows of each source are put into a seeded random order. Row r of n gets the
fractional rank (r + u) / n, with an offset u in [0, 1) of its source's own, so
that sources of one row don't all meet at the same rank. All rows sorted by
fractional rank interleave the sources evenly, and cutting that order into equal
runs gives shards that each hold the mixture.

Law `rows`: counts of shards differ by one at most. The method places every row
by itself and keeps no groups: rows of equal texts, the groups of the contract,
are spread over the shards like any others.

Edge cases: null text is empty (8 bytes, checksum 0); the null source is a
source; null and repeated ids are ordered by `tie`; rows equal in both are
interchangeable, and many of them are dealt to pieces of their own; fewer rows
than shards leave shards empty; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import seeded_key, sized_join, whole_row
from quillspark.storage import materialise

PIECE_DIGITS = 3
#: Rows that are sorted together at least, and runs of the global order at most.
RUN_ROWS, MAX_RUNS = 2000, 8192
#: A piece of more rows than this and than `HOT_TIMES` the mean of its source holds rows of one key, which are dealt to `HOT_PARTS` pieces.
HOT_ROWS, HOT_TIMES, HOT_PARTS = 100_000, 4, 1024


def deal_hot(base: DataFrame, pieces: DataFrame) -> DataFrame | None:
    """`base` with rows of the keys that many rows share in pieces of their own, written; None if there is no such key.

    `pieces` counts the rows of (no_source, source, piece).

    Those pieces follow the one that the key is from, so the order stays one that the rows decide.
    """
    by_piece = ["no_source", "source", "piece"]
    mean = F.sum("n").over(Window.partitionBy("no_source", "source")) / F.lit(16**PIECE_DIGITS)
    hot = materialise(pieces.withColumn("most", F.greatest(mean * HOT_TIMES, F.lit(float(HOT_ROWS)))).filter("n > most").select(*by_piece, "most"), "hot-pieces")
    if hot.isEmpty():
        return None
    own = sized_join(base.select(*by_piece, "key"), hot, by_piece, "inner", [F.col("key")])
    keys = own.groupBy(*by_piece, "key").agg(F.count("*").alias("n"), F.first("most").alias("most")).filter("n * 2 > most")
    marked = sized_join(base, materialise(keys.select(*by_piece, "key", F.lit(True).alias("hot")), "hot-keys"), [*by_piece, "key"], "left", [F.col("key")])
    place = F.lpad(F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PARTS)).cast("string"), 4, "0")
    piece = F.when(F.col("hot"), F.concat_ws("-", "piece", "key", place)).otherwise(F.col("piece"))
    return materialise(marked.withColumn("piece", piece).drop("hot"), "dealt-rows")


def shard(df: DataFrame, row_id: Column, source: Column, tie: Column, shards: int = 24, seed: int = 29) -> DataFrame:
    """Columns row, shard, slot; a row for each of `df`.

    Places are found for keys and their counts alone, in two levels (pieces of a
    source, runs of the fractional rank), so that no task holds a source or the
    whole order; the rows themselves move once, to the places of their key.
    """
    base = df.select(
        whole_row(df), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"),
        seeded_key(seed, row_id, tie).alias("key"),
    ).withColumn("piece", F.substring("key", 1, PIECE_DIGITS))
    by_source, by_piece, by_key = ["no_source", "source"], ["no_source", "source", "piece"], ["no_source", "source", "piece", "key"]

    count = lambda rows: materialise(rows.groupBy(*by_key).agg(F.count("*").alias("n")), "shard-keys")
    keys = count(base)
    dealt = deal_hot(base, keys.groupBy(*by_piece).agg(F.sum("n").alias("n")))
    if dealt is not None:
        base, keys = dealt, count(dealt)
    total = keys.agg(F.sum("n")).first()[0] or 0
    own = Window.partitionBy(*by_source)
    pieces = keys.groupBy(*by_piece).agg(F.sum("n").alias("piece_n"))
    offsets = pieces.select(*by_piece, (F.sum("piece_n").over(own.orderBy("piece")) - F.col("piece_n")).alias("before"), F.sum("piece_n").over(own).alias("source_n"))
    upto = F.sum("n").over(Window.partitionBy(*by_piece).orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("no_source").cast("string"), F.lit(":"), F.col("source"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    runs = min(MAX_RUNS, max(1, -(-total // RUN_ROWS)))
    first = keys.join(offsets.hint("merge"), by_piece).withColumn("first", F.col("before") + upto - F.col("n"))
    ranked = first.select(*by_key, "source_n", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank"))
    ranked = ranked.withColumn("part", (F.col("rank") + unit) / F.col("source_n")).withColumn("run", F.floor(F.col("part") * runs).cast("int")).drop("source_n")
    ranked = materialise(ranked, "shard-ranks")

    run_sizes = ranked.groupBy("run").agg(F.count("*").alias("n"))
    run_starts = run_sizes.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("run_start"))  # MAX_RUNS rows
    place = F.row_number().over(Window.partitionBy("run").orderBy("part", *by_source, "rank")) - 1
    placed = ranked.withColumn("place", place).join(run_starts, "run").withColumn("place", F.col("place") + F.col("run_start"))
    shard_of = F.expr(f"(place * {shards}) div {max(total, 1)}").cast("int")
    begins = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", shard_of).select(*by_key, F.struct("shard", (F.col("place") - begins).cast("long").alias("slot")).alias("p"))
    places = placed.groupBy(*by_key).agg(F.collect_list("p").alias("places"))  # a key's rows, which `deal_hot` bounds
    copy = F.row_number().over(Window.partitionBy(*by_key).orderBy("key"))
    mine = F.get("places", (F.col("copy") - 1).cast("int"))
    return base.withColumn("copy", copy).join(places.hint("merge"), by_key).select("row", mine["shard"].alias("shard"), mine["slot"].alias("slot"))
