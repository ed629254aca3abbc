"""Operators by their own interface: methods, bounds and splits that the queries don't reach on small tables."""

import hashlib
import struct
import time
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from quillspark.llm import common, components, decontam, embed_dedup, langid, line_dedup, mixing, sharding, simhash, toxicity, url_filter, warc
from quillspark.llm.unions import join
from quillspark.storage import materialise


def test_mined_rules_are_those_of_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        tokens = [t for t, p in (("host:a", 0.5), ("path:x", 0.4), ("path:y", 0.3), ("query:z", 0.1)) if rng.random() < p]
        rows.append((tokens, bool(("path:x" in tokens and "path:y" in tokens) or rng.random() < 0.1)))
    got = {tuple(sorted(r["antecedent"])): r for r in url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, block boolean"), 0.02, 0.6, 1.2).collect()}
    want = {}
    names = ["host:a", "path:x", "path:y", "query:z"]
    for k in range(1, 5):
        for own in combinations(names, k):
            fits = [b for t, b in rows if set(own) <= set(t)]
            if fits and sum(fits) / len(fits) >= max(0.6, 1.2 * sum(b for _, b in rows) / len(rows)) and sum(fits) >= 0.02 * len(rows):
                want[tuple(sorted(own))] = sum(fits) / len(fits)
    assert set(got) == set(want) and ("path:x", "path:y") in got
    assert all(abs(got[k]["confidence"] - c) < 1e-9 for k, c in want.items())
    counts = {t: sum(t in own for own, _ in rows) for t in names}
    assert all(r["token"] == min(k, key=lambda t: (counts[t], t)) for k, r in got.items())


def test_few_rows_teach_no_rule_and_long_urls_no_flood(spark):
    make = lambda rows: spark.createDataFrame(rows, "tokens array<string>, block boolean")
    assert url_filter.mine_rules(make([(["host:a"], True)] * 4 + [(["host:b"], False)] * 40)).count() == 0
    long = [f"path:{i}" for i in range(60)]
    mined = url_filter.mine_rules(make([(long, True)] * 30 + [(["path:1"], False)] * 60 + [(None, True), (["host:z"], None), ([], True)]))
    assert 0 < mined.count() < 2**url_filter.MAX_ITEMS
    assert mined.filter("confidence < 0.6 or lift < 1.5").isEmpty()


def test_rules_of_long_urls_are_the_shortest_of_brute_force(spark):
    rng = np.random.default_rng(3)
    names = [f"path:{x}" for x in "abcdefg"]
    rows = []
    for _ in range(300):
        own = [t for t, p in zip(names, (0.9, 0.7, 0.5, 0.5, 0.4, 0.3, 0.3)) if rng.random() < p]
        own += ["host:d"] * ("path:d" in own) + ["host:all"]  # one that goes without saying beside d, one beside anything
        rows.append((own, bool(({"path:c", "path:d"} <= set(own) and rng.random() < 0.8) or ({"path:b", "path:e", "path:f"} <= set(own)) or rng.random() < 0.1)))
    base = sum(b for _, b in rows) / len(rows)
    every = {}
    for k in range(1, 10):
        for some in combinations([*names, "host:d", "host:all"], k):
            fits = [b for t, b in rows if set(some) <= set(t)]
            if fits and sum(fits) >= max(5, 0.01 * len(rows)) and sum(fits) / len(fits) >= max(0.6, 1.2 * base):
                every[frozenset(some)] = (sum(fits) / len(fits), sum(fits) / len(rows))
    want = {k: v for k, v in every.items() if not any(x < k for x in every)}
    table = spark.createDataFrame(rows, "tokens array<string>, block boolean")
    got = url_filter.mine_rules(table, 0.01, 0.6, 1.2, 5, max_items=3).collect()
    assert {frozenset(r["antecedent"]) for r in got} == set(want) and len(got) == len(want) < len(every) and max(map(len, want)) > 2
    assert all(abs(r[c] - want[frozenset(r["antecedent"])][i]) < 1e-9 for r in got for i, c in enumerate(("confidence", "support")))
    listed = url_filter.mine_rules(table, 0.01, 0.6, 1.2, 5, max_items=9).collect()
    assert {frozenset(r["antecedent"]) for r in listed} == set(every)
    counts = {t: sum(t in own for own, _ in rows) for t in [*names, "host:d", "host:all"]}
    assert all(r["token"] == min(r["antecedent"], key=lambda t: (counts[t], t)) for r in got)


def test_every_frequent_token_of_a_long_url_is_combined(spark):
    long = [f"path:t{i}" for i in range(40)]  # all more telling than x and y, and none a rule
    rows = [([*long, "path:x", "path:y"], True)] * 20 + [(long, True)] * 30 + [(long, False)] * 50 + [(["path:x"], False), (["path:y"], False)] * 40
    mined = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, block boolean"))
    assert {tuple(sorted(r["antecedent"])) for r in mined.collect()} == {("path:x", "path:y")} | {(t, x) for t in long for x in ("path:x", "path:y")}
    pages = spark.createDataFrame([("http://h/x/y",), ("http://h/x/z",), ("http://h/y/t39",), ("http://h/" + "/".join(f"t{i}" for i in range(40)),)], "url string")
    assert sorted(r["url"] for r in url_filter.match_rules(pages, mined).collect()) == ["http://h/x/y", "http://h/y/t39"]


def test_url_verdicts_come_from_mined_rules(spark):
    mined = spark.createDataFrame([(["path:spam", "query:q"], 0.9, 3.0, 0.1, "path:spam")], "antecedent array<string>, confidence double, lift double, support double, token string")
    pages = spark.createDataFrame([(1, "http://h/spam?q=1"), (2, "http://h/spam"), (3, "http://h.ok/spam?q=1"), (4, None), (1, "http://h/spam?q=1"), (5, "http://h/" + "spam/" * 20000 + "?q")], "id long, url string")
    for rows in (100, 0):
        got = url_filter.judge(pages, F.col("url"), [("ok", "/", "allow")], mined, rows).select("row.id", "rule", "verdict", "decided_by").collect()
        want = [(1, None, "block", "mined"), (1, None, "block", "mined"), (2, None, "allow", "default"), (3, "ok/", "allow", "listed"), (4, None, "allow", "default"), (5, None, "block", "mined")]
        assert sorted(map(tuple, got)) == want


def test_tables_too_large_to_broadcast_are_not_broadcast_for_their_small_files(spark):
    left = spark.range(2000).select((F.col("id") % 300).alias("k"), "id")
    right = materialise(spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "right")
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = common.sized_join(left, right, ["k"], how, [F.col("id")], rows=100)
        assert sorted(map(str, joined.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    blocked = spark.createDataFrame([("x" * 950,), ("",), (None,), ("ab",)], "url string")
    assert common.sized_rows(blocked, F.col("url")) == 13 and common.sized_rows(blocked.limit(0), F.col("url")) == 0


def test_decontamination_beyond_its_bounds(spark, messy):
    docs, items = spark.read.parquet(f"{messy}/documents.parquet"), spark.read.parquet(f"{messy}/benchmark.parquet")
    tables = (docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"))
    run = lambda **bounds: sorted(map(str, decontam.decontaminate(*tables, **bounds).drop("row").collect()))
    assert run() == run(scan_shingles=20, rows=0)
    kept = lambda **bounds: sorted(str(r["doc_id"]) for r in decontam.keep_clean(*tables, **bounds).collect())
    good = sorted(str(r["doc_id"]) for r in decontam.decontaminate(*tables).filter("not contaminated").select("row.doc_id").collect())
    assert kept() == good and kept(rows=0) == good and decontam.keep_clean(*tables).columns == docs.columns


def test_windows_that_share_shingles_but_not_words(spark):
    w = [f"w{i}" for i in range(30)]
    texts = [w, w[:13], w[:12], w[:6] + ["x"] + w[6:], w[5:10] * 4, w[:5] + w[8:13] + w[5:8], ["x", *w[3:16], "y"], w[17:], w[::-1]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[17:])), (3, "w5 w6"), (4, "w9")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontam.decontaminate(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text")).select("row.doc_id", "n_words", "n_hit").collect()}
    windows = [w[i : i + 13] for i in range(18)] + [w[5:7], w[9:10]]
    for i, t in enumerate(texts):
        hit = {k for x in windows for a in range(len(t)) if t[a : a + len(x)] == x for k in range(a, a + len(x))}
        assert got[i] == (len(t), len(hit)), i


def brute_labels(prints, budget=4):
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= budget
    return join(np.arange(len(prints)), *np.nonzero(np.triu(near, 1)))


@pytest.mark.parametrize("seed", range(5))
def test_trie_walk_finds_the_components_of_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [base[rng.integers(40)] ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 6))))) for _ in range(300)]
    prints = np.unique(np.concatenate([base, np.array(near, np.uint64), np.arange(70, dtype=np.uint64)]))
    assert (simhash.walk(prints, np.zeros(len(prints), int)) == brute_labels(prints)).all()


@pytest.mark.parametrize("n,agree", [(1000, 1), (1 << 20, 2), (1 << 26, 2), (1 << 34, 4)])
def test_blocks_follow_the_number_of_fingerprints(n, agree):
    blocks, got = simhash.plan_blocks(n, 4)
    assert got == agree and len(blocks) == 4 + agree and sum(w for _, w in blocks) == 64


@pytest.mark.parametrize("subtrie,cell_rows", [(20_000, 40_000), (20, 50)])
def test_large_subtries_are_cut_without_losing_links(spark, monkeypatch, subtrie, cell_rows):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**62))
    prints = np.unique(np.array([centre ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 3))) for _ in range(150)] + [int(x) for x in rng.integers(0, 2**63, 100)], np.uint64))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    edges = simhash.subtries(df, len(prints), 4, subtrie, cell_rows).groupBy("cell").applyInPandas(simhash.link_cell, "a long, b long")
    root = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    label = brute_labels(prints)
    got = [root.get(int(p), int(p)) for p in prints.view(np.int64)]
    assert pd.Series(got).groupby(label).nunique().max() == 1 and len(set(got)) == len(set(label))


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (7, 8), (8, 7)], "a long, b long")
    root = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert len({root[i] for i in range(61)}) == 1 and len({root[1000 + i] for i in range(80)}) == 1 and len(set(root.values())) == 2
    assert components.connected_components(edges.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark, messy, tables):
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    got = simhash.keep_first(docs, F.col("doc_id"), F.col("text"))
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in simhash.keep_first(docs, F.col("doc_id"), F.col("text"), rows=0).collect())
    assert ids.count(1) == 1 and not {200 + k for k in range(40)} & set(ids) and ids.count(10) == 1 and None not in ids
    prints = np.unique(np.array([simhash.fingerprint(d[1]) for d in tables["documents"]], np.uint64))
    assert len(ids) == len(set(brute_labels(prints)))  # ids 11 stand in two groups


def test_archive_begins_with_its_dictionary(tmp_path):
    archive = warc.Archive(f"file://{tmp_path}/a")
    payloads = [(f"<p>page {i} of the same site, with the same words</p>" * 20).encode() for i in range(400)]
    for i, p in enumerate(payloads):
        archive.add(warc.record(i, f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), None))
    done = archive.close()
    raw = open(done["path"].removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and raw[8:12] == b"\x37\xa4\x30\xec"
    engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    first = engine.decompressobj()
    assert first.decompress(raw[8 + size :]).startswith(b"WARC/1.1") and first.unused_data  # a record is a frame
    assert [p for _, p in warc.read_archive(done["path"])] == payloads
    assert done["records"] == 400 and len(raw) < done["bytes"] / 5


def test_small_archives_and_full_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"text {i}" * 50) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages)
    assert manifest.count() > 3
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(manifest, True).collect()}
    assert got == {i: f"text {i}" * 50 for i in range(30)}


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in toxicity.new_net(rng).items()}
    vocab = toxicity.hashed(["some", "words", "of", "a", "text"])
    index, mask = rng.integers(0, 5, (toxicity.WINDOW, 3)), np.arange(toxicity.WINDOW)[:, None] < np.array([5, 48, 20])

    def loss_of(logit):
        p = toxicity.sigmoid(logit)
        return float(-np.log(p).sum()), p - 1

    _, grad = toxicity.gradient(net, index, mask, vocab, loss_of)
    for name in ("wf", "ub", "att", "att_v", "out", "bf"):
        at = tuple(rng.integers(s) for s in net[name].shape)
        up, down = ({**net, name: net[name].copy()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        slope = (toxicity.gradient(up, index, mask, vocab, loss_of)[0] - toxicity.gradient(down, index, mask, vocab, loss_of)[0]) / 2e-2
        assert abs(slope - grad[name][at]) < 0.02 * max(abs(slope), 0.05), name


def test_network_learns_words_and_their_stems():
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    make = lambda bad: [w if rng.random() > 0.06 or not bad else "vrutz" + rng.choice(["en", "ig", "heit"]) for w in rng.choice(plain, rng.integers(30, 200))]
    data = [(k % 2, make(k % 2)) for k in range(500)]
    cut = lambda words: [words[s : s + toxicity.WINDOW] for s in toxicity.starts_of(len(words))]
    net = toxicity.train([(label, cut(w)) for label, w in data[:400]], steps=150)
    scores = toxicity.score_texts(net, [" ".join(w) for _, w in data[400:]] + ["", None, "?!"])
    assert ((scores[:100] >= 0.5) == np.array([label for label, _ in data[400:]])).mean() > 0.9
    assert (scores[100:] == 0).all()
    long = " ".join(data[400][1]) * 3000 + " vrutzen vrutzig vrutzheit vrutzen"
    assert toxicity.score_texts(net, [long])[0] >= 0.5  # the end of a long text counts


def test_windows_cover_every_word():
    for n in range(1, 400):
        starts = toxicity.starts_of(n)
        assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= n and (np.diff(starts) == toxicity.STRIDE).all()
        assert len(starts) == 1 or starts[-2] + toxicity.WINDOW < n


def test_training_needs_both_classes():
    assert toxicity.train([(0, [["a"]])] * 5) is None and (toxicity.score_texts(None, ["a", None]) == 0).all()


def brute_links(x, cosine):
    near = (x @ x.T) >= cosine
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("seed", range(4))
def test_dual_walk_finds_the_links_of_brute_force(seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, 16))
    x = embed_dedup.unit(list(np.concatenate([centres[rng.integers(20, size=300)] + rng.standard_normal((300, 16)) * rng.choice([0.01, 0.2, 0.4], (300, 1)), rng.standard_normal((100, 16))])))
    weight = rng.integers(1, 5, len(x))
    near = brute_links(x, 0.93)
    tree = embed_dedup.cover_tree(x, np.arange(len(x)))
    links, label = embed_dedup.dual_walk(x, weight, tree, tree, 0.93)
    assert (links == near @ weight).all() and (label == join(np.arange(len(x)), *np.nonzero(np.triu(near)))).all()
    a, b = np.arange(150), np.arange(150, len(x))
    links, _ = embed_dedup.dual_walk(x, weight, embed_dedup.cover_tree(x, a), embed_dedup.cover_tree(x, b), 0.93)
    between = near.copy()
    between[:150, :150] = between[150:, 150:] = False
    assert (links == between @ weight).all()


def test_dense_groups_are_not_walked_pair_by_pair():
    rng = np.random.default_rng(0)
    x = embed_dedup.unit(list(np.concatenate([rng.standard_normal((500, 64)), rng.standard_normal(64) + rng.standard_normal((1500, 64)) * 0.09])))
    tree = embed_dedup.cover_tree(x, np.arange(2000))
    began = time.process_time()
    links, _ = embed_dedup.dual_walk(x, np.ones(2000, int), tree, tree, 0.93)
    assert (links == brute_links(x, 0.93).sum(axis=1)).all() and links.sum() > 10**6 and time.process_time() - began < 20


def test_levels_are_nested_and_cover():
    x = embed_dedup.unit(list(np.random.default_rng(1).standard_normal((200, 5))))
    todo = [(embed_dedup.cover_tree(x, np.arange(200)), None)]
    while todo:
        node, parent = todo.pop()
        assert np.linalg.norm(x[node.points] - x[node.centre], axis=1).max() <= node.radius + 1e-7
        if node.children:
            assert node.children[0].centre == node.centre  # nested
            assert sorted(p for c in node.children for p in c.points) == sorted(node.points)
            assert all(c.radius <= node.radius for c in node.children)
        todo += [(c, node) for c in node.children]


def test_labels_are_cut_into_parts_without_losing_links(spark, messy, monkeypatch):
    df = spark.read.parquet(f"{messy}/embeddings.parquet")
    run = lambda: sorted(map(str, embed_dedup.near_duplicates(df, F.col("vec_id"), F.col("embedding"), F.col("label")).drop("row").collect()))
    whole = run()
    real = embed_dedup.cells
    monkeypatch.setattr(embed_dedup, "cells", lambda nodes: real(nodes, 10, 30))
    assert run() == whole


def test_long_texts_are_scored_whole(monkeypatch):
    monkeypatch.setattr(langid, "PIECE_CHARS", 50)
    rng = np.random.default_rng(0)
    table = rng.standard_normal((langid.BUCKETS, 2))
    texts = ["kurz", "", "ein langer Text über Häuser und Bäume. " * 20, "a b", "x" * 130]
    got = langid.sum_by_text(texts, table)
    for text, row in zip(texts, got, strict=True):
        found, _ = langid.grams(langid.code_points(text))
        assert np.allclose(row, table[found].sum(axis=0))


def test_materialised_tables_are_read_back(spark):
    df = spark.createDataFrame([(1, None), (2, ["x"])], "a long, b array<string>")
    assert sorted(map(str, materialise(df, "t").collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("ids", ["one", "null", "equal"])
def test_hot_ids_are_mixed_and_sharded_exactly(spark, monkeypatch, ids):
    """Rows of one id, of none, or equal in all columns, a hundred thousand of them."""
    monkeypatch.setattr(sharding, "HOT_ROWS", 1000)
    monkeypatch.setattr(mixing, "COPIES", 700)
    n = 100_000
    row_id = {"one": F.lit(7), "null": F.lit(None).cast("long"), "equal": F.lit(7)}[ids]
    text = F.lit("x") if ids == "equal" else F.col("id").cast("string")
    df = spark.range(n).select(row_id.alias("id"), text.alias("text"), F.lit("a").alias("source"), F.lit(3).alias("words"))
    df = materialise(df.unionByName(spark.range(5000).select((F.col("id") + 100).alias("id"), F.lit("y").alias("text"), F.when(F.col("id") % 2 == 0, "b").alias("source"), F.lit(40).alias("words"))), "hot")
    mixed = mixing.mix(df, F.col("id"), F.col("source"), F.col("words"), F.md5("text"))
    got = mixed.groupBy("row.source").agg(F.count("*").alias("n"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("repeats").alias("most")).collect()
    assert {r["source"]: r["n"] for r in got} == {"a": n, "b": 2500, None: 2500}
    assert all(abs(r["taken"] - r["target"]) <= 40 and r["most"] <= 2 for r in got)
    placed = sharding.shard(df, F.col("id"), F.col("source"), F.md5("text"), shards=7)
    counts = placed.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert len(counts) == 7 and sum(r["n"] for r in counts) == n + 5000 and all(r["n"] == r["slots"] == r["last"] + 1 and abs(r["n"] - (n + 5000) / 7) < 1 for r in counts)
    pieces = df.select(F.substring(common.seeded_key(1, F.col("id"), F.md5("text")), 1, 3)).distinct().count()
    assert pieces > 3000 or ids == "equal"


def test_one_id_brings_one_text_to_the_sample(spark, monkeypatch):
    docs = spark.range(3000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")).unionByName(spark.range(2, 40).select(F.col("id").alias("doc_id"), F.lit("other words").alias("text")))
    labels = docs.select(F.col("doc_id").alias("row_id")).distinct().withColumn("label", (F.col("row_id") % 2).cast("int"))
    seen, real = {}, toxicity.materialise
    monkeypatch.setattr(toxicity, "materialise", lambda df, name: seen.setdefault(name, real(df, name)))
    toxicity.fit(docs, F.col("doc_id"), F.col("text"), labels, steps=1)
    assert seen["toxic-texts"].count() == 39


def test_lines_are_cut_by_their_share_of_a_host(spark):
    pages = [("a", ["x", "y", "u1"]), ("a", ["x", "u2"]), ("b", ["x", "x"]), ("c", ["m", "n"]), ("c", ["m", "o"]), ("c", ["o"]), (None, None), ("d", []), *[("hot", ["top", f"p{i}"]) for i in range(50)]]
    df = spark.createDataFrame([(i, h, ls) for i, (h, ls) in enumerate(pages)], "id long, h string, l array<string>")
    for rows in (10**6, 0):
        got = {r["id"]: (r["lines"], r["kept"]) for r in line_dedup.drop_boilerplate(df, F.col("h"), F.col("l"), rows=rows).select("row.id", "lines", "kept").collect()}
        for i, (host, lines) in enumerate(pages):
            site = [set(ls or []) for h, ls in pages if (h or "") == (host or "")]
            held = lambda x, site=site: sum(x in s for s in site)
            want = None if lines is None else [x for x in lines if not (held(x) > 1 and held(x) > 0.5 * len(site))]
            assert got[i] == (lines, want), i


def test_archives_go_where_hadoop_paths_point(tmp_path, monkeypatch):
    """`s3a` is Hadoop's name of a scheme that Arrow knows under another."""
    from pyarrow import fs

    from quillspark import storage
    from quillspark.llm import warc

    class Local:
        @staticmethod
        def from_uri(uri):
            assert uri.startswith("s3://bucket/"), uri
            return fs.LocalFileSystem(), uri.replace("s3://bucket", str(tmp_path))

    monkeypatch.setattr(fs, "FileSystem", Local)
    archive = warc.Archive("s3a://bucket/checkpoints/warc")
    archive.add(warc.record(1, "http://a/", b"payload", "d", None))
    done = archive.close()
    with pytest.raises(ValueError, match="damaged"):  # the digest above isn't the payload's
        list(warc.read_archive(done["path"]))
    assert storage.arrow_uri(done["path"]).startswith("s3://bucket/checkpoints/warc/")


def test_the_walk_prunes_by_radii_and_loses_no_link():
    from quillspark.llm import embed_dedup

    rng = np.random.default_rng(3)
    centres = embed_dedup.unit(list(rng.normal(size=(12, 16))))
    x = embed_dedup.unit([c + rng.normal(size=16) * scale for c in centres for scale in (0.01, 0.05, 0.12) for _ in range(40)])
    root, seen = embed_dedup.cover_tree(x, np.arange(len(x))), {}
    links, label = embed_dedup.dual_walk(x, np.ones(len(x), np.int64), root, root, 0.93, seen)
    hits = x @ x.T >= 0.93
    np.fill_diagonal(hits, False)
    assert (links == hits.sum(axis=1)).all()
    assert sum(seen.values()) == len(x) * (len(x) - 1) // 2 and seen["pruned"] > 0 and seen["whole"] > 0 and seen["compared"] > 0
    linked = {(i, j) for i, j in zip(*np.nonzero(hits), strict=True)}
    assert all((label[i] == label[j]) for i, j in linked)
