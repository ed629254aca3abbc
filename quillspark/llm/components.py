"""Connected components by repeated contraction, as DataFrame joins.

In each round every node looks at its closed neighbourhood and joins the node
that comes first in an order drawn anew for the round. Edges are carried over to
the nodes that are left, until none remains; a constant share of the nodes goes
in each round. Nodes with many edges are summed up before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.storage import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (a, b: long); equal roots mean connected."""
    left = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found, turn = None, 0
    while not left.isEmpty():
        turn += 1
        drawn = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("p"), F.col(c).alias("id"))  # noqa: E731, B023
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(drawn("b")).alias("near"))
        step = materialise(first.select(F.col("a").alias("from"), F.least("near", drawn("a"))["id"].alias("to")), "step")
        moved = left.join(step.select(F.col("from").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("from").alias("b"), F.col("to").alias("y")), "b")
        left = materialise(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if found is None:
            found = step.select(F.col("from").alias("node"), F.col("to").alias("root"))
        else:
            found = materialise(found.join(step, found["root"] == step["from"], "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    return found if found is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
