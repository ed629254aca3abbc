"""Groups of equal texts by most-significant-digit radix partitioning, without digests.

The first digit of a text is its length with its first bytes, each further one
its next bytes, eight times as many as before, so a text of n bytes is split
some log n times. In each round the rows of a group that is still open are split
by their digit. A group of one row is done, and so is a group whose texts have
ended: equal lengths and equal digits are equal texts. Only rows of open groups
carry the rest of their text into the next round.

Digits are counted before the shuffle. Groups of two rows and more are joined
back to the rows; they are broadcast if their digits fill SMALL bytes at most.
Beyond that the groups that hold more than a HEAVY-th of the open rows, so HEAVY
at most, are joined on their own, broadcast or in shares of the rows, and the
others, none of which is large, by a shuffle.

Edge cases: null is the empty text; of rows that repeat the largest id of their
group all stay, and if all ids are null, all stay; null ids go before any other;
an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import sized_join
from quillspark.storage import materialise

#: Bytes of the first digit, and how much longer each digit is than the one before.
WIDTH, GROWTH = 64, 8
#: Bytes of digits that are broadcast at most; groups with more than one in so many open rows are joined on their own, in so many shares if they are too long for a broadcast.
SMALL, HEAVY, SHARES = 16 << 20, 2000, 64
LONGEST = (1 << 31) - 1


def split(rows: DataFrame, n_rows: int, width: int, small: int, heavy: int) -> DataFrame:
    """Rows (row, id, node, rest) after one digit: their new node, its size n, the largest id, what is left of the text, and whether the node is done."""
    cut = rows.select("row", "id", "node", F.substring("rest", 1, width).alias("digit"), F.substring("rest", width + 1, LONGEST).alias("rest"))
    sizes = cut.groupBy("node", "digit").agg(F.count("*").alias("n"), F.max("id").alias("largest")).filter("n > 1")
    nodes = materialise(sizes.withColumn("next", F.monotonically_increasing_id()), "radix-nodes")
    large = F.col("n") * heavy > n_rows
    room = (F.octet_length("digit") + 64).cast("long")
    whole, some = nodes.agg(F.coalesce(F.sum(room), F.lit(0)), F.coalesce(F.sum(F.when(large, room)), F.lit(0))).first()
    if whole <= small:
        joined = cut.join(F.broadcast(nodes), ["node", "digit"], "left")
    else:
        few = nodes.filter(large)
        meet = lambda how: sized_join(cut, few, ["node", "digit"], how, [F.col("id"), F.col("row")], small, SHARES, some)
        joined = meet("inner").unionByName(meet("left_anti").join(nodes.filter(~large), ["node", "digit"], "left"))
    alone = F.col("n").isNull()
    done = (alone | (F.octet_length("rest") == 0)).alias("done")
    found = joined.select("row", "id", "next", F.coalesce("n", F.lit(1)).alias("n"), F.when(alone, F.col("id")).otherwise(F.col("largest")).alias("largest"), "rest", done)
    return materialise(found.withColumn("rest", F.when(~F.col("done"), F.col("rest"))).withColumnRenamed("next", "node"), "radix-rows")


def exact_groups(docs: DataFrame, row_id: Column, text: Column, carried: list[str] | None = None, width: int = WIDTH, small: int = SMALL, heavy: int = HEAVY) -> DataFrame:
    """row (all columns of `docs`, or the carried ones), keep_id, group_size, kept for each row; the row with the largest id of its group stays."""
    row = F.struct(*[F.col(f"`{c}`") for c in carried or docs.columns]).alias("row")
    content = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = docs.select(row, row_id.alias("id"), F.octet_length(content).cast("long").alias("node"), content.alias("rest"))
    n_rows, done = docs.count(), []
    while True:
        found = split(rows, n_rows, width, small, heavy)
        done.append(found.filter("done"))
        rows = found.filter("not done").select("row", "id", "node", "rest")
        n_rows, width = rows.count(), width * GROWTH
        if not n_rows:
            break
    ended = reduce(DataFrame.unionByName, done)
    return ended.select("row", F.col("largest").alias("keep_id"), F.col("n").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("largest")).alias("kept"))


def keep_one(docs: DataFrame, row_id: Column, text: Column) -> DataFrame:
    """`docs` with one row of each group of equal texts: that with the largest id."""
    return exact_groups(docs, row_id, text).filter("kept").select("row.*")
