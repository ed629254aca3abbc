"""SimHash near-duplicates: fingerprints, and a binary-trie self-join on them.

A fingerprint has a bit set where over half of the hashes of a document's
4-word shingles have it. Equal fingerprints are one node from here on.

Fingerprints that differ in at most `budget` bits are found by walking pairs of
nodes of a binary trie together: differing bits add up on the way down, a pair
goes when they exceed the budget, and a pair whose remaining bits can't exceed
it any more is linked as a whole. The trie is dealt out by the pigeonhole
principle: of `budget + agree` blocks of bits, `agree` are equal in any two
fingerprints to be linked, so that for each choice of blocks a subtrie holds the
fingerprints equal in them. `agree` follows the number of fingerprints. A
subtrie of more than `SUBTRIE` fingerprints is cut into parts, and every two
parts meet in a task of their own. Tasks return a spanning forest, not pairs.

Edge cases: null, empty and blank texts have fingerprint zero and link like any
other; null ids are never the smallest unless all are; repeated rows are in one
group; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillspark.llm.common import BROADCAST_ROWS, row_keys, sized_join, whole_row
from quillspark.llm.components import connected_components
from quillspark.llm.unions import join
from quillspark.storage import materialise

BITS, BUDGET, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints of a subtrie that stay together, rows of a task, and node pairs that are walked at once.
SUBTRIE, CELL_ROWS, PAIRS = 20_000, 40_000, 1 << 18
#: Fingerprints that share the bits of a subtrie at random, at most.
BUCKET = 64
#: Shingles whose bits are counted at once.
PIECE = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for a in range(0, len(ends), PIECE):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[a : a + PIECE], ends[a : a + PIECE], strict=False)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(ends)).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed longs."""
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def plan_blocks(n: int, budget: int, bucket: int = BUCKET) -> tuple[list[tuple[int, int]], int]:
    """Blocks (first bit, width) and how many of them must agree, for n fingerprints."""
    for agree in range(1, 7):
        count = budget + agree
        edges = [BITS * i // count for i in range(count + 1)]
        blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        if n <= bucket << (BITS // count * agree):
            break
    return blocks, agree


def walk(prints: np.ndarray, group: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each of the fingerprints, sorted by (group, fingerprint), the place of its local root.

    Links are found between fingerprints of one group. `label` holds the roots.
    """
    n = len(prints)
    label = np.arange(n)
    if n < 2:
        return label
    begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    lo, hi = begins[:-1], begins[1:]
    several = hi - lo > 1
    lo, hi = lo[several], hi[several]
    stack = [(BITS, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    zeros_before: dict[int, np.ndarray] = {}
    while stack:
        left, a0, a1, b0, b1, errors = stack.pop()
        if len(a0) > PAIRS:
            for k in range(0, len(a0), PAIRS):
                stack.append((left, *(x[k : k + PAIRS] for x in (a0, a1, b0, b1, errors))))
            continue
        # Pairs that are in one component already have no news.
        run = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        known = (run[a0] == run[a1 - 1]) & (run[b0] == run[b1 - 1]) & (label[a0] == label[b0])
        a0, a1, b0, b1, errors = (x[~known] for x in (a0, a1, b0, b1, errors))
        if not len(a0):
            continue
        # Leaves against leaves: all remaining bits at once.
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            near = np.bitwise_count(prints[x] ^ prints[y]) <= budget
            label = join(label, x[near], y[near])
        # Remaining bits that can't exceed the budget: all below are linked.
        sure = ~leaf & (errors + left <= budget)
        for s, e in ((a0[sure], a1[sure]), (b0[sure], b1[sure])):
            sizes = e - s - 1
            own = np.repeat(s, sizes)
            label = join(label, own, own + 1 + np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        label = join(label, a0[sure], b0[sure])
        go = ~leaf & ~sure
        a0, a1, b0, b1, errors = (x[go] for x in (a0, a1, b0, b1, errors))
        if not len(a0):
            continue
        left -= 1
        if left not in zeros_before:
            zeros_before[left] = np.concatenate(([0], np.cumsum((prints >> np.uint64(left)) & np.uint64(1) == 0)))
        z = zeros_before[left]
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        same = a0 == b0
        parts = []
        for x0, x1, y0, y1, more, which in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            keep = (x1 > x0) & (y1 > y0) & (errors + more <= budget)
            if which is not None:
                keep &= which
            keep &= ~((x1 - x0 == 1) & (x0 == y0))  # a leaf with itself
            parts.append([v[keep] for v in (x0, x1, y0, y1, errors + np.int8(more))])
        stack.append((left, *(np.concatenate(p) for p in zip(*parts, strict=True))))
    return label


def link_cell(cell: pd.DataFrame) -> pd.DataFrame:
    """Spanning edges a, b of one task's subtries (fp, sub, part)."""
    prints = cell["fp"].to_numpy(np.int64).view(np.uint64)
    key = cell[["sub", "part"]].to_numpy(np.int64)
    order = np.lexsort((prints, key[:, 1], key[:, 0]))
    prints, key = prints[order], key[order]
    group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]).any(axis=1))))
    label = walk(prints, group)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"a": prints[moved].view(np.int64), "b": prints[label[moved]].view(np.int64)})


def subtries(prints: DataFrame, n: int, budget: int, subtrie: int = SUBTRIE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """fp, sub, part, cell: the subtries that each fingerprint is in, and the tasks they go to.

    `sub` is a hash of the choice of blocks and their bits; should two subtries
    share it, their fingerprints are walked together, and no link changes.
    """
    blocks, agree = plan_blocks(n, budget)
    bits = lambda first, width: F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
    choices = [F.xxhash64(F.lit(i), *[bits(*blocks[k]) for k in chosen]) for i, chosen in enumerate(combinations(range(len(blocks)), agree))]
    rows = prints.select("fp", F.explode(F.array(*choices)).alias("sub"))
    large = materialise(rows.groupBy("sub").agg(F.count("*").alias("size")).filter(F.col("size") > subtrie), "large-subtries")
    cells = max(1, -(-n * len(choices) // cell_rows))
    usual = F.pmod(F.xxhash64("sub", F.lit("cell")), F.lit(cells))
    if large.isEmpty():
        return rows.select("fp", "sub", F.lit(0).cast("long").alias("part"), usual.alias("cell"))
    parts = F.ceil(F.col("size") * 2 / subtrie).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("parts") - 1), F.array("mine"))))
    dealt = rows.join(large.withColumn("parts", parts), "sub", "left").withColumn("mine", mine).select("fp", "sub", "parts", "mine", other.alias("other"))
    pair = F.coalesce(F.least("mine", "other").cast("long") * F.col("parts") + F.greatest("mine", "other") + 1, F.lit(0))
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(pair).cast("long")
    return dealt.withColumn("part", part).select("fp", "sub", "part", F.when(F.col("part") == 0, usual).otherwise(F.xxhash64("sub", "part")).alias("cell"))


def link_fingerprints(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """node, root for the fingerprints (fp: long, distinct) that link with another."""
    n = prints.count()
    edges = subtries(prints, n, budget).groupBy("cell").applyInPandas(link_cell, "a long, b long")
    return connected_components(edges)


def fingerprints(df: DataFrame, row_id: Column, text: Column) -> DataFrame:
    """row_id, k1, k2, fp of every row, written once."""
    return materialise(df.select(row_id.alias("row_id"), *row_keys(row_id, text), fingerprint_of(text).alias("fp")), "fingerprints")


def near_duplicates(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """row_id, fp, component_id for the rows of `fingerprints`."""
    groups = materialise(prints.groupBy("fp").agg(F.min("row_id").alias("least")), "distinct-fingerprints")
    roots = link_fingerprints(groups.select("fp"), budget)
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(smallest, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("row_id", "k1", "k2", "fp", "component_id")


def keep_first(df: DataFrame, row_id: Column, text: Column, budget: int = BUDGET, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of `df` that stay: of each group the one with the smallest id.

    Null ids come last; of rows that are equal in id and text, one stays. An id
    that stands in two groups may stay in both. Texts stay where they are while
    the keys of the rows that go can be broadcast.
    """
    keys = ["k1", "k2"]
    prints = fingerprints(df, row_id, text)
    groups = materialise(prints.groupBy("fp").agg(F.min(F.struct(F.col("row_id").isNull().alias("no"), "row_id", *keys)).alias("first")), "distinct-fingerprints")
    roots = link_fingerprints(groups.select("fp"), budget)
    first = groups.join(roots, groups["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = first.select("first.k1", "first.k2", F.lit(True).alias("stays")).distinct()
    counted = prints.groupBy(*keys).agg(F.count("*").alias("n")).join(kept, keys, "left").filter("stays is null or n > 1")
    marked = materialise(counted, "rows-that-go")
    rest = sized_join(df.select(whole_row(df), *row_keys(row_id, text)), marked, keys, "left", [F.col("k1")], rows)
    out = rest.filter("n is null").select("row")
    if not marked.filter("stays").isEmpty():  # repeated rows, of which one stays
        once = rest.filter("stays").groupBy(*keys).agg(F.first("row").alias("row"))
        out = out.unionByName(once.select("row"))
    return out.select("row.*")
