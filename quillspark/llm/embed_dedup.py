"""Embedding near-duplicates by dual traversal of cover trees.

Vectors that are equal, under one label, are one node with a count. The nodes
of a label are dealt into parts of some `PART` nodes, and every two parts meet
in a task, so that no task holds a label; small labels share tasks.

A task builds a cover tree over each part: nested levels of centres whose radii
halve, every point within the radius of its centre. Two trees are then walked
together. A pair of nodes goes if its centres are further apart than the
threshold and both covering radii allow, is linked as a whole if they are so
near that no point can be beyond the threshold, and is otherwise split into its
children; points of two leaves are compared one by one. A task returns a count
of links for each node and a spanning forest, not pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label, link with nothing; vectors of unequal
length don't link; copies of a vector link with each other; repeated rows are
other vectors; a null id is a component of its own name, null, if it has no
links, and never the smallest otherwise; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import whole_row
from quillspark.llm.components import connected_components
from quillspark.llm.unions import join
from quillspark.storage import materialise

COSINE = 0.93
#: Nodes of a part, nodes that share a task, points of a leaf.
PART, CELL_NODES, LEAF = 4096, 4096, 32
#: Rows of a product of points or centres that are held at once.
ROWS = 512
#: Room for rounding when whole nodes are pruned or linked.
SLACK = 1e-7


def unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Node:
    """A centre, the points it covers, the farthest of them, and its children."""

    __slots__ = ("centre", "points", "radius", "children")

    def __init__(self, points: np.ndarray, cosines: np.ndarray) -> None:
        """`cosines` are those of the points with the first, the centre."""
        self.centre, self.points, self.children = points[0], points, []
        self.radius = max(2 - 2 * float(cosines.min()), 0.0) ** 0.5


def cover_tree(x: np.ndarray, points: np.ndarray) -> Node:
    """The root of a tree over the unit vectors x[points]."""
    root = Node(points, x[points] @ x[points[0]])
    todo = [(root, root.radius / 2)]
    while todo:
        node, radius = todo.pop()
        if len(node.points) <= LEAF or node.radius <= SLACK:
            continue
        while radius >= node.radius:
            radius /= 2
        near = 1 - radius * radius / 2
        own = x[node.points]
        begin, cosines = 0, np.empty((0, len(own)))
        left = np.arange(len(own))  # the centre comes first, so levels are nested
        while len(left):
            if left[0] >= begin + len(cosines):  # centres come in order, so a few rows of the product are held
                begin = left[0]
                cosines = own[begin : begin + ROWS] @ own.T
            row = cosines[left[0] - begin, left]
            covered = row >= near
            covered[0] = True
            child = Node(node.points[left[covered]], row[covered])
            node.children.append(child)
            todo.append((child, radius / 2))
            left = left[~covered]
    return root


def dual_walk(x: np.ndarray, weight: np.ndarray, first: Node, second: Node, cosine: float, seen: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each point (weighted), and its root in the forest of links; `seen` counts the pairs of points that were pruned, linked whole and compared."""
    seen = {} if seen is None else seen

    def count(what: str, pairs: int) -> None:
        seen[what] = seen.get(what, 0) + int(pairs)

    reach = float(np.sqrt(2 - 2 * cosine))
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))
    a_side: list[np.ndarray] = []
    b_side: list[np.ndarray] = []
    held = 0

    def linked(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label, held
        a_side.append(a)
        b_side.append(b)
        held += len(a)
        if held > 1 << 20:
            label = join(label, np.concatenate(a_side), np.concatenate(b_side))
            a_side.clear()
            b_side.clear()
            held = 0

    todo = [(first, second)]
    while todo:
        p, q = todo.pop()
        same = p is q
        if same and len(p.points) == 1:
            continue
        gap = 0.0 if same else float(np.sqrt(max(2 - 2 * float(x[p.centre] @ x[q.centre]), 0)))
        pairs = len(p.points) * len(q.points) if not same else len(p.points) * (len(p.points) - 1) // 2
        if gap > reach + p.radius + q.radius + SLACK:
            count("pruned", pairs)
            continue
        if gap + p.radius + q.radius <= reach - SLACK:  # all points of both
            count("whole", pairs)
            a, b = p.points, q.points
            links[a] += weight[b].sum() - (weight[a] if same else 0)
            if not same:
                links[b] += weight[a].sum()
            linked(np.full(len(a) + len(b), a[0]), np.concatenate((a, b)))
            continue
        if not (p.children or q.children):
            count("compared", pairs)
            hits = x[p.points] @ x[q.points].T >= cosine
            if same:
                np.fill_diagonal(hits, False)
            i, j = np.nonzero(hits)
            if len(i):
                links[p.points] += hits @ weight[q.points]
                if not same:
                    links[q.points] += weight[p.points] @ hits
                linked(p.points[i], q.points[j])
            continue
        left, right = p.children or [p], q.children or [q]
        if same:
            todo += [(c, c) for c in left]
        ours, theirs = (np.array([c.centre for c in s]) for s in (left, right))
        radii = np.array([c.radius for c in left]) + (reach + SLACK), np.array([c.radius for c in right])
        for k in range(0, len(left), ROWS):
            far = radii[0][k : k + ROWS, None] + radii[1]
            near = 2 - 2 * (x[ours[k : k + ROWS]] @ x[theirs].T) <= far * far
            if same:
                near = np.triu(near, k + 1)
            todo += [(left[k + i], right[j]) for i, j in zip(*np.nonzero(near), strict=True)]
            away = ~np.triu(~near, k + 1) if same else near
            sizes = np.array([len(c.points) for c in left[k : k + ROWS]]), np.array([len(c.points) for c in right])
            count("pruned", sizes[0] @ (~away) @ sizes[1])
    if a_side:
        label = join(label, np.concatenate(a_side), np.concatenate(b_side))
    return links, label


def link_cell(cell: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """id, links, root of the nodes of one task that have links there."""
    out = []
    for _, group in cell.groupby(["label", "length", "pair"], sort=False):
        group = group.reset_index(drop=True)
        x, ids = unit(list(group["embedding"])), group["id"].to_numpy()
        one = np.flatnonzero(group["side"].to_numpy() == 0)
        two = np.flatnonzero(group["side"].to_numpy() == 1)
        if not len(one):
            continue
        first = cover_tree(x, one)
        if len(two) or group["between"].iloc[0]:
            if not len(two):
                continue
            second = cover_tree(x, two)
        else:
            second = first
        links, label = dual_walk(x, group["n"].to_numpy(np.int64), first, second, cosine)
        some = links > 0
        out.append(pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[label[some]]}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "links": [], "root": []}, dtype="int64")


def usable(vector: Column, label: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def cells(nodes: DataFrame, part: int = PART, cell_nodes: int = CELL_NODES) -> DataFrame:
    """Nodes as they are dealt to tasks: label, length, pair, side, between, cell."""
    sizes = materialise(nodes.groupBy("label", "length").agg(F.count("*").alias("size")), "label-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    parts = F.ceil(F.col("size") / part).cast("int")
    dealt = nodes.join(sizes.withColumn("parts", parts).drop("size"), ["label", "length"])
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    small = F.pmod(F.xxhash64("label", "length"), F.lit(max(1, -(-total // cell_nodes))))
    return dealt.select(
        "id", "embedding", "n", "label", "length", (low.cast("long") * F.col("parts") + high).alias("pair"), (F.col("mine") > F.col("other")).cast("int").alias("side"),
        (low != high).alias("between"), F.when(F.col("parts") == 1, small).otherwise(F.xxhash64("label", "length", low, high)).alias("cell"),
    )


def near_duplicates(df: DataFrame, vec_id: Column, vector: Column, label: Column, cosine: float = COSINE) -> DataFrame:
    """Columns row, vec_id, n_links, component_id, kept; a row for each of `df`."""
    base = df.select(whole_row(df), vec_id.alias("vec_id"), vector.alias("embedding"), label.alias("label"), usable(vector, label).alias("ok"))
    keys = ["label", "h1", "h2"]
    good = base.filter("ok").withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit("2"), "embedding")})
    nodes = good.groupBy(*keys).agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    nodes = materialise(nodes.select("*", F.size("embedding").alias("length"), F.monotonically_increasing_id().alias("id")), "vectors")
    found = materialise(cells(nodes).groupBy("cell").applyInPandas(lambda c: link_cell(c, cosine), "id long, links long, root long"), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    rooted = nodes.select("id", *keys, "n", "least").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    rooted = materialise(rooted.select(*keys, "least", F.coalesce("root", "id").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector-roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(smallest, "root").select(*keys, "n_links", "component_id"), "vector-components")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    linked = good.join(named, keys).select("row", "vec_id", "n_links", "component_id", kept)
    alone = base.filter("not ok").select("row", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return linked.unionByName(alone)
