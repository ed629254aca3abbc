"""Repair of conversations and reassembly of their turns, against SQL and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from quillspark.llm import repair
from quillspark.llm.oracle import ORACLES
from quillspark.llm.queries import QUERIES


def by_query(spark, name, folder):
    df = QUERIES[name](spark, folder)
    return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())


def by_sql(name, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    rows = con.sql(ORACLES[name])
    return Counter(con.sql(f"SELECT {', '.join(sorted(rows.columns))} FROM rows").fetchall())


def cheapest(turns):
    """All edits of up to two insertions before each turn and at the end, tried one by one."""
    found = []

    def go(i, state, cost, audit, left):
        if left and state != "x":
            go(i, {"": "u", "s": "u", "u": "a", "a": "u"}[state], cost + 5, audit + "I", left - 1)
        if i == len(turns):
            if state in ("", "a"):
                found.append((cost, audit))
            return
        initial, _, retainable, cut = turns[i]
        go(i + 1, state, cost + 2, audit + "D", 2)
        for role in "sua" if retainable else "":
            if role in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                if initial == role:
                    go(i + 1, role, cost + 5 * cut, audit + "K", 2)
                if role != "s":
                    go(i + 1, role, cost + 1 + 5 * cut, audit + "R", 2)

    go(0, "", 0, "", 2)
    return min(found)


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(150):
        turns = [(rng.choice(["s", "u", "a", "t", ""]), 1, rng.random() < 0.8, rng.random() < 0.4) for _ in range(rng.randint(0, 4))]
        costs, picks = repair.plan(turns, repair.LAST)
        assert (costs[0], "".join(m for m, *_ in repair.edits(turns, picks, 0, True))) == cheapest(turns), turns


def test_repair_equals_its_sql(spark, messy):
    got = by_query(spark, "op12_conversation_repair", messy)
    assert got == by_sql("op12_conversation_repair", messy)
    assert {r[2] for r in got} > {None, 100, 201}


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "system", "Well. Yes?") for c in range(40) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c, t, role, text, n in repair.damage(df, *map(F.col, ("conv_id", "turn", "role", "text"))).collect():
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        assert (role, text, n) == ("user" if kind == 4 else "system", {1: "", 2: "Well Yes"}.get(kind, "Well. Yes?"), {0: 0, 3: 2}.get(kind, 1))


def test_long_conversations_are_repaired_in_blocks(spark, messy):
    turns = repair.damage(spark.read.parquet(f"{messy}/conversations.parquet"), *map(F.col, ("conv_id", "turn", "role", "text")))
    whole = repair.summarise(*repair.repair_conversations(turns))
    for rows, size, block in ((3, 1 << 30, 4), (50, 1 << 30, 8), (1000, 5000, 16)):
        cut, pieces = repair.repair_conversations(turns, rows=rows, size=size, block=block)
        assert pieces is not None and pieces.groupBy("conv_id").count().agg(F.max("count")).first()[0] > (5 if rows < 1000 else 0)
        assert Counter(map(tuple, repair.summarise(cut, pieces).collect())) == Counter(map(tuple, whole.collect()))


def simulated(rows):
    """Events by a loop over batches and rows."""
    batches, out = defaultdict(dict), []
    firsts = {}
    for conv, turn, role, text, *_ in rows:
        if turn is None:
            continue
        h = int(hashlib.sha256(f"{'' if conv is None else conv}:{turn}".encode()).hexdigest()[:8], 16)
        firsts[conv] = min(firsts.get(conv, turn), turn)
        for batch, own in [(h % 8, role or "")] + ([((h + 3) % 8, "user")] if h % 7 < 2 else []):
            key = (f"{own}|{text or ''}".encode(), own)
            at = batches[batch].get((conv, turn))
            batches[batch][conv, turn] = min(at, key) if at else key
    kept, last, closed, after = defaultdict(dict), {}, {}, dict(firsts)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def close(conv, batch):
        closed[conv] = batch
        own = kept[conv]
        waiting = ",".join(str(t) for t in sorted(own) if t >= after[conv])
        out.append(("close", conv, -1, batch, sha(waiting.encode()), max(own) - firsts[conv] + 1 - len(own), sum(t - 1 in own and own[t - 1][1] == own[t][1] for t in own)))

    for batch in range(8):
        for (conv, turn), payload in batches[batch].items():
            if conv in closed:
                out.append(("reject", conv, turn, batch, sha(payload[0]), None, None))
            else:
                last[conv] = batch
                kept[conv].setdefault(turn, payload)
        for conv in kept:
            while conv not in closed and after[conv] in kept[conv]:
                out.append(("release", conv, after[conv], batch, sha(kept[conv][after[conv]][0]), None, None))
                after[conv] += 1
            if conv not in closed and batch == last[conv] + 3:
                close(conv, batch)
    for conv in kept:
        if conv not in closed:
            close(conv, 8)
    return Counter((b, c, e, br, mi, s, t) for e, c, t, b, s, mi, br in out)


def test_reassembly_equals_a_loop_and_its_sql(spark, messy, tables):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = by_query(spark, "op13_turn_reassembly", messy)
    assert got == simulated(tables["conversations"])
    assert got == by_sql("op13_turn_reassembly", messy)
    assert {r[2] for r in got} == {"release", "reject", "close"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_arrivals_before_due_timers_are_rejected(spark):
    from quillspark.llm import reassembly

    rows = [(1, 0, "user", "a", 0), (1, 1, "user", "late", 4), (2, 5, "user", "b", 0), (2, 5, "user", "again", 3), (2, 6, "user", "in time", 3), (2, 8, "user", "waits", 3)]
    got = reassembly.reassemble(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, batch int"), batches=5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("release", 1, 0, 0, "user|a", None, None), ("close", 1, -1, 3, "", 0, 0), ("reject", 1, 1, 4, "user|late", None, None),
        ("release", 2, 5, 0, "user|b", None, None), ("release", 2, 6, 3, "user|in time", None, None), ("close", 2, -1, 5, "8", 1, 1),
    ], key=str)


def test_checkpoint_files_have_no_second_file(spark):
    """Each part of the state writes one file a start; files that begin with a dot are the local file system's own."""
    from pathlib import Path

    from quillspark import storage
    from quillspark.llm import reassembly

    rows = spark.createDataFrame([(1, 0, "user", "a", 0), (2, 0, "user", "b", 0)], "conv_id long, turn long, role string, text string, batch int")
    assert reassembly.reassemble(rows, batches=1).count() == 4
    root = next(p for p in reversed(storage._written) if "/reassembly-" in p)
    names = [f.name for f in Path(root.removeprefix("file://")).glob("checkpoint/state/**/*")]
    assert any(n.endswith(".changelog") for n in names) and not [n for n in names if n.endswith(".crc") and not n.startswith(".")]
