"""Repair of the structure of conversations by their cheapest edits.

A conversation is right if its roles' initials are `(s?(ua)+)?`. Each turn is
kept, given another role or deleted, and turns without text are inserted. Which
turns stay is a dynamic program over the retained turns, from the last to the
first: the price of a gap is a difference of prefix sums of deletions, so the
best turn to retain next is a running minimum for each role it may have, and the
two roles decide what is inserted between. Of equally cheap edits those whose
initials come first in ASCII win: a longer gap, then I, K and R; from one state
no two of them have the same initial, so no strings are compared.

A conversation within the bounds of ROWS and BYTES is one row. A longer one is
dealt to ranges of its order and cut to blocks: a block's costs from each state
to each other make a small table, tables are combined from the last block to the
first, then states from the first to the last, and blocks are repaired side by
side. Only those tables of a conversation meet in one task, and the digest of
its text, which is sequential by nature, is taken piece by piece as a stream.

Edge cases: nulls are one space wherever they are read as text; rows of equal
turn are ordered by role, then by text; an empty role has no initial, so it
can't be kept; repeated rows are duplicates; a conversation of which damage
leaves nothing has zeros and empty texts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.storage import materialise

#: Rows and bytes of text of a conversation that one task takes whole, and rows of a block of a longer one (a power of two).
ROWS, BYTES, BLOCK = 5_000, 32 << 20, 4_096
#: Prices of edits: a new role, a deletion, an insertion, keeping a truncated turn.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
NEVER = 1 << 50
#: States: nothing retained so far, or the role of the last retained turn.
START, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = ("", "s", "u", "a")
NAMES = ("", "system", "user", "assistant")
#: For each state, the roles that may follow and how many insertions stand between.
FOLLOW = (((SYSTEM, 0), (USER, 0), (ASSISTANT, 1)), ((USER, 0), (ASSISTANT, 1)), ((USER, 1), (ASSISTANT, 0)), ((USER, 0), (ASSISTANT, 1)))
#: Price of the insertions that end a conversation in each state.
LAST = [0, 2 * INSERT, INSERT, 0]
INK = re.compile(r"[^\x20\x09-\x0D]")
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
PIECE = "conv_id long, piece long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<string>"
Turn = tuple[str, int, bool, bool]


def price(turn: Turn, role: int) -> int:
    """Of retaining a turn (initial, copies, retainable, truncated) with a role; all copies but the first go."""
    initial, copies, retainable, cut = turn
    own = initial == LETTERS[role]
    if not retainable or role == SYSTEM and not own:
        return NEVER
    return (0 if own else REROLE) + CUT * cut + DELETE * (copies - 1)


def plan(turns: list[Turn], exits: list[int]) -> tuple[list[int], list[list]]:
    """Least costs from each state before the first turn, if leaving in a state costs `exits`; for each place and state what is retained next: (index, role, insertions) or None."""
    total = gone = DELETE * sum(t[1] for t in turns)
    nearest = [(NEVER, -1)] * 4
    picks: list[list] = [[]] * (len(turns) + 1)
    costs: list[int] = []
    for i in range(len(turns), -1, -1):
        # gone: price of deleting all turns before i.
        costs, row = [], []
        for state in range(4):
            best, pick, mark = min(NEVER, total - gone + exits[state]), None, ""
            for role, insertions in FOLLOW[state]:
                value, j = nearest[role]
                cost = value - gone + INSERT * insertions
                if cost > best or cost >= NEVER:
                    continue
                own = "I" if insertions else "K" if turns[j][0] == LETTERS[role] else "R"
                if cost < best or pick and (-j, own) < (-pick[0], mark):
                    best, pick, mark = cost, (j, role, insertions), own
            costs.append(best)
            row.append(pick)
        picks[i] = row
        if i:
            gone -= DELETE * turns[i - 1][1]
            for role in (SYSTEM, USER, ASSISTANT):
                value = gone + price(turns[i - 1], role) + costs[role]
                if value < min(nearest[role][0], NEVER):
                    nearest[role] = (value, i - 1)
    return costs, picks


def edits(turns: list[Turn], picks: list[list], state: int, last: bool) -> Iterator[tuple[str, int | None, int]]:
    """(initial of the edit, index of its turn, role or state) from `state` on; the end's insertions follow if this is the last block."""
    i = 0
    while True:
        pick = picks[i][state]
        until = pick[0] if pick else len(turns)
        for k in range(i, until):
            yield "D" * turns[k][1], None, state
        if not pick:
            break
        j, role, insertions = pick
        if insertions:
            yield "I", None, USER if role == ASSISTANT else ASSISTANT
        yield "K" if turns[j][0] == LETTERS[role] else "R", j, role
        yield "D" * (turns[j][1] - 1), None, role
        i, state = j + 1, role
    if last:
        for role in {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(state, ()):
            yield "I", None, role
    yield "", None, state


def legal(one: str, two: str) -> bool:
    return one + two in ("su", "ua", "au")


def examine(rows: list[dict], seen: set | None) -> tuple[list[Turn], dict[str, int]]:
    """Turns and counts of faults of rows (role, text, n); repeats are found by `seen`, or are marked in the rows."""
    turns, found, before = [], dict.fromkeys(COUNTS, 0), None
    for row in rows:
        role, text, n = row["role"], row["text"], row["n"]
        blank = not INK.search(text)
        again = row["again"] if seen is None else (role, text) in seen
        if seen is not None:
            seen.add((role, text))
        cut = not blank and not again and text.rstrip(SPACE)[-1] not in ".!?"
        found["blank"] += n * blank
        found["duplicate"] += 0 if blank else n if again else n - 1
        found["truncated"] += cut
        found["illegal"] += n - 1 + (before is not None and not legal(before, role[:1]))
        before = role[:1]
        turns.append((before, n, not blank and not again, cut))
    return turns, found


def written(rows: list[dict], made: Iterator[tuple[str, int | None, int]]) -> tuple[str, list[str]]:
    """The audit and the repaired turns as `role:text`."""
    audit, lines = [], []
    for mark, j, role in made:
        audit.append(mark)
        if mark == "I":
            lines.append(f"{NAMES[role]}:")
        elif j is not None:
            lines.append(f"{rows[j]['role'] if mark == 'K' else NAMES[role]}:{rows[j]['text']}")
    return "".join(audit), lines


def mend(rows: list[dict]) -> dict:
    """A whole conversation (turn, role, text, n), in order."""
    turns, found = examine(rows, set())
    costs, picks = plan(turns, LAST)
    audit, lines = written(rows, edits(turns, picks, START, True))
    own = {r["turn"] for r in rows if r["turn"] is not None}
    return found | {"gaps": max(own) - min(own) + 1 - len(own) if own else 0, "cost": costs[START], "audit": audit, "repaired": lines, "piece": 0}


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def damage(df: DataFrame, conv_id: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """conv_id, turn, role, text, n: rows damaged by a hash of their name; n is how often a row stands there, 0 if it is dropped."""
    name = F.concat(F.coalesce(conv_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = F.crc32(name) % 20
    own = F.coalesce(text, F.lit(" "))
    marred = F.when(kind == 1, "").when(kind == 2, F.translate(own, ".!?", "")).otherwise(own)
    return df.select(conv_id.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(F.coalesce(role, F.lit(" "))).alias("role"), marred.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def mend_batches(batches):
    for batch in batches:
        rows = [{"conv_id": c} | mend(own) for c, own in zip(batch["conv_id"].to_pylist(), batch["rows"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, arrow_schema(PIECE))


def repair_conversations(turns: DataFrame, rows: int = ROWS, size: int = BYTES, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """Repairs of turns (conv_id, turn, role, text, n): conversations as one row each, and pieces of those that are longer, if there are any."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("size"))
    # Each holds `rows` rows or `size` bytes, so they are few.
    long = materialise(sizes.filter((F.col("rows") > rows) | (F.col("size") > size)).select(F.col("conv_id").alias("c")), "long-conversations")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    some = not long.isEmpty()
    short = turns.join(long, same, "left_anti") if some else turns
    row = F.when(F.col("n") > 0, F.struct("turn", "role", "text", "n"))
    gathered = short.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    whole = gathered.mapInArrow(mend_batches, PIECE)
    return whole, repair_long(turns.join(long, same, "left_semi"), block) if some else None


def block_tables(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Costs from each state to each other, and the first and last initials, of a block."""
    rows = table.sort_by("pos").to_pylist()
    turns = [(r["initial"], r["n"], r["retainable"], r["cut"]) for r in rows]
    to = [plan(turns, [0 if k == end else NEVER for k in range(4)])[0] for end in range(4)]
    return pa.Table.from_pylist([{"key": key[0].as_py(), "block": key[1].as_py(), "costs": [to[end][state] for state in range(4) for end in range(4)], "first": turns[0][0], "last": turns[-1][0]}], TABLES_SCHEMA)


TABLES = "key string, block long, costs array<long>, first string, last string"
TABLES_SCHEMA = arrow_schema(TABLES)
EXITS = "key string, block long, exits array<long>, final long, border long"
PATHS = "key string, block long, leaves array<long>"
STATES = "key string, block long, state long"


def exit_costs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """What leaving each block in each state costs, from the last block to the first; whether its border is illegal."""
    rows = table.sort_by("block").to_pylist()
    exits, out = LAST, []
    for i in range(len(rows) - 1, -1, -1):
        r = rows[i]
        out.append({"key": r["key"], "block": r["block"], "exits": exits, "final": int(i == len(rows) - 1), "border": int(i > 0 and not legal(rows[i - 1]["last"], r["first"]))})
        exits = [min(NEVER, *(r["costs"][4 * state + end] + exits[end] for end in range(4))) for state in range(4)]
    return pa.Table.from_pylist(out, arrow_schema(EXITS))


def block_paths(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The state in which a block is left, for each in which it is entered."""
    rows = table.sort_by("pos").to_pylist()
    turns = [(r["initial"], r["n"], r["retainable"], r["cut"]) for r in rows]
    picks = plan(turns, rows[0]["exits"])[1]
    leaves = []
    for state in range(4):
        for *_, end in edits(turns, picks, state, False):
            pass
        leaves.append(end)
    return pa.Table.from_pylist([{"key": key[0].as_py(), "block": key[1].as_py(), "leaves": leaves}], arrow_schema(PATHS))


def entered(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The state in which each block is entered, from the first to the last."""
    state, out = START, []
    for r in table.sort_by("block").to_pylist():
        out.append({"key": r["key"], "block": r["block"], "state": state})
        state = r["leaves"][state]
    return pa.Table.from_pylist(out, arrow_schema(STATES))


def mend_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A piece: a block's part of the repair; what it costs is the difference of what its ends cost."""
    rows = table.sort_by("pos").to_pylist()
    turns, found = examine(rows, None)
    state, exits, last = rows[0]["state"], rows[0]["exits"], bool(rows[0]["final"])
    costs, picks = plan(turns, exits)
    made = list(edits(turns, picks, state, last))
    audit, lines = written(rows, iter(made))
    found["illegal"] += rows[0]["border"]
    end = made[-1][2]
    piece = {"piece": key[1].as_py(), "gaps": 0, "cost": costs[state] - (0 if last else exits[end]), "audit": audit, "repaired": lines, "conv_id": rows[0]["conv_id"]}
    return pa.Table.from_pylist([found | piece], arrow_schema(PIECE))


def repair_long(turns: DataFrame, block: int) -> DataFrame:
    """Pieces of conversations that no task takes whole; their gaps stand in their first piece."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("key")
    rows = turns.filter("n > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).withColumn("range", F.spark_partition_id().cast("long"))
    dealt = materialise(dealt, "long-conversations-dealt")
    place = F.row_number().over(Window.partitionBy("range").orderBy("conv_id", "turn", "role", "text"))
    placed = dealt.withColumn("pos", F.col("range") * (1 << 32) + place).withColumn("block", F.floor(F.col("pos") / block).cast("long")).withColumn("key", key)
    digest = F.sha2("text", 256)
    firsts = placed.groupBy("key", "role", digest.alias("digest")).agg(F.min("pos").alias("pos")).select("pos", F.lit(False).alias("again"))
    marked = placed.join(firsts, "pos", "left").withColumn("again", F.coalesce("again", F.lit(True)))
    marked = materialise(marked.select("conv_id", "key", "block", "pos", "turn", "role", "text", "n", "again"), "long-conversations-marked")
    ink = F.rtrim(F.translate("text", SPACE[1:], " " * 5))
    blank = ink == ""
    steps = marked.select("key", "block", "pos", F.substring("role", 1, 1).alias("initial"), "n", (~blank & ~F.col("again")).alias("retainable"), (~blank & ~F.col("again") & ~ink.rlike(r"[.!?]\z")).alias("cut"))
    exits = materialise(steps.groupBy("key", "block").applyInArrow(block_tables, TABLES).groupBy("key").applyInArrow(exit_costs, EXITS), "block-exits")
    leaves = steps.join(exits.select("key", "block", "exits"), ["key", "block"]).groupBy("key", "block").applyInArrow(block_paths, PATHS)
    states = materialise(leaves.groupBy("key").applyInArrow(entered, STATES), "block-states")
    known = marked.join(exits, ["key", "block"]).join(states, ["key", "block"])
    pieces = known.groupBy("key", "block").applyInArrow(mend_block, PIECE)
    gaps = marked.filter("turn is not null").groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("own"))
    first = exits.groupBy("key").agg(F.min("block").alias("piece"))
    placed_gaps = gaps.withColumn("key", key).join(first, "key").select(F.col("key").alias("k"), F.col("piece").alias("p"), "own")
    joined = pieces.withColumn("key", key).join(placed_gaps, (F.col("key") == F.col("k")) & (F.col("piece") == F.col("p")), "left")
    none = turns.groupBy("conv_id").agg(F.max("n").alias("n")).filter("n = 0")
    nothing = none.select("conv_id", F.lit(0).cast("long").alias("piece"), *[F.lit(0).cast("long").alias(c) for c in ("gaps", *COUNTS)], F.lit("").alias("audit"), F.array().cast("array<string>").alias("repaired"))
    return joined.select("conv_id", "piece", F.coalesce("own", "gaps").alias("gaps"), *COUNTS, "audit", "repaired").unionByName(nothing)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest_pieces(batches):
    """A row for each conversation from its pieces in order; texts are hashed as they pass."""
    def pieces():
        for batch in batches:
            yield from batch.to_pylist()

    for conv_id, own in groupby(pieces(), key=lambda r: r["conv_id"]):
        sums, audit, text, begun = dict.fromkeys(("gaps", *COUNTS), 0), [], hashlib.sha256(), False
        for row in own:
            for c in sums:
                sums[c] += row[c]
            audit.append(row["audit"])
            for line in row["repaired"]:
                text.update(("\n" if begun else "").encode() + line.encode())
                begun = True
        yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "audit": "".join(audit), "repaired_sha256": text.hexdigest()} | sums], arrow_schema(SUMMARY))


def summarise(whole: DataFrame, pieces: DataFrame | None) -> DataFrame:
    """A row for each conversation, with the digest of its repaired text."""
    own = whole.select("conv_id", "gaps", *COUNTS, "audit", F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"))
    if pieces is None:
        return own
    streams: Callable[[DataFrame], DataFrame] = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(digest_pieces, SUMMARY)
    return own.unionByName(streams(pieces))
