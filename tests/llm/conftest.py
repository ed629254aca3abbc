"""Small tables that hold what real ones hold only now and then."""

import random

import pytest

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, row string, size long, k1 long, shard int, words string, label string",
    "labels": "doc_id long, quality int, toxic int, row string",
    "pages": "page_id long, url string, html string, host string, lines string, digest string",
    "benchmark": "item_id long, text string, words string, window string",
    "conversations": "conv_id long, turn long, role string, text string, row string, n int, batch int, first int, block int, key string",
    "embeddings": "vec_id long, embedding array<float>, label int, id long, part int",
}
WORDS = {
    "en": "the of and house river tree going with three morning light green water stone under early winter garden".split(),
    "de": "der die und haus fluss baum gehen mit drei morgen licht grün wasser stein unter früh winter garten".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", "n", "s", "er"]) for _ in range(n))


def make_documents() -> list[tuple]:
    rng = random.Random(5)
    rows = []
    for i in range(150):
        lang = "de" if i % 3 == 0 else "en"
        rows.append([i, sentence(rng, lang, rng.randint(5, 60)), lang, f"s{i % 4}"])
    texts = [r[1] for r in rows]
    passage = sentence(rng, "en", 30)
    for k in range(40):  # a hot source with copies, near copies and passages
        rows.append([200 + k, texts[1], "en", "s0"])
        rows.append([300 + k, texts[4] + " " + texts[5] + " " + texts[7] + " " + texts[8] + f" extra{k % 5}", "en", "s0"])
    rows += [
        [400, passage, "en", "s1"], [401, texts[2] + " " + passage.upper() + " tail", "en", "s1"], [402, " ".join(passage.split()[:12]), "en", "s2"],
        [403, None, None, None], [404, "", "en", None], [405, " \t\n ", "de", "s9"], [406, "?!.. 12 34", None, "s9"], [None, texts[10], "en", "s1"], [None, None, None, None],
        [407, " ".join([sentence(rng, "en", 500)] * 30), "en", "s2"], [408, "Word", "en", "é"], [409, "word", "en", "z"], [410, "ÄÖÜ äöü ßß", "de", "s1"], [411, "a" * 5000, "en", "s1"],
        [10, texts[10], "en", "s2"], [10, texts[10], "en", "s2"], [11, texts[12], "en", "s3"],
    ]
    return [(i, t, lang, s, len(t or ""), "x", 1, 2, 3, "w", "l") for i, t, lang, s in rows]


def make_conversations() -> list[tuple]:
    """Ordinary ones, and some with nulls in any column, ties, repeated rows, gaps, odd roles and a length that needs blocks."""
    rng = random.Random(8)
    roles = ["user", "assistant"]
    rows = []
    for c in range(60):
        begin = c % 2
        rows += [(c, begin + k, "system" if begin == 0 and k == 0 and c % 4 == 0 else roles[(k + (c % 4 == 0)) % 2], sentence(rng, "en", rng.randint(0, 6)) + rng.choice([".", "?", "!", "", " .\n", "\u00a0"])) for k in range(rng.randint(1, 9))]
    rows += [(100, k, rng.choice([*roles, "tool", "user"]), rng.choice(["yes.", "no", "", f"turn {k}."])) for k in range(300)]
    rows += [(100, 7, "user", "yes.")] * 40
    rows += [
        (200, None, "user", "first."), (200, None, "user", "first."), (200, None, None, None), (200, 3, "assistant", "b."), (200, 3, "assistant", "a."), (200, 3, "assistant", "a."),
        (201, None, "user", "alone."), (202, 5, None, "x."), (202, 6, "", "y."), (202, -3, "assistant", "z"), (203, 1, "user", " \t\n "), (203, 2, "ux", "odd."), (203, 9, "user", "far."),
        (None, 1, "user", "nobody's."), (None, 2, "assistant", "nobody's?"), (None, None, None, None), (204, 1, "user", "long " * 30000 + "."), (204, 2, "assistant", "ü" * 9000),
        (205, 1, "a|b", "c"), (205, 1, "a", "b|c"), (205, 2, "a", "d|"), (205, 2, "a", "d|"),
    ]
    return [(*r, "x", 1, 2, 3, 4, "k") for r in rows]


def make_tables() -> dict[str, list[tuple]]:
    rng = random.Random(6)
    docs = make_documents()
    passage = next(d[1] for d in docs if d[0] == 400)
    html = "<html><nav><a>Home</a></nav><p>{}</p><div>All rights reserved</div></html>"
    pages = [(i, f"http://a{i % 3}.Example.com/en/{i}?x=1", html.format(sentence(rng, "en", 12)), "h", "l", "d") for i in range(30)]
    pages += [(100 + i, "https://www.example.com/en/1", html.format("same") + "<p>Line</p>" * 10, "h", "l", "d") for i in range(20)]
    pages += [
        (200, None, None, None, None, None), (201, "no scheme", "", None, None, None), (202, "http://b.net/es/x", "short", "h", None, None), (203, "http://b.net/es/x", "short", "h", None, None),
        (204, "http://b.net", "ä" * 100, None, None, None), (205, "http://com/a?b#c", "ä" * 100, None, None, None), (None, "http://b.net/fr/", "ä" * 100, None, None, None),
        (206, "http://b.net/x\r\ny z/ü", "<p>" + "long " * 20000 + "</p>", None, None, None), (207, "x://u@H:1/p://q#", "<b>", None, None, None), (5, pages[5][1], pages[5][2], "h", "l", "d"),
    ]
    blocked = [i for i in range(1, 60) if i % 4 == 0 or i % 5 == 0]
    pages += [(300 + k, f"http://spam.b.org/win/{i}", f"<p>offer {i}</p>", "h", "l", "d") for k, i in enumerate([*blocked, 7, 7000, 7001])]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(60)]
    vectors += [(100 + i, [x + rng.gauss(0, 0.15) for x in vectors[0][1]], 0) for i in range(40)]
    vectors += [(200 + i, list(vectors[1][1]), 1) for i in range(20)]
    odd = [(300, None, 0), (301, [], 0), (302, [0.0] * 8, 0), (303, [1.0, None] * 4, 0), (304, [float("nan")] * 8, 0), (305, [float("inf")] * 8, 0), (306, list(vectors[0][1]), None), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (None, list(vectors[2][1]), 2), (2, list(vectors[2][1]), 2)]
    return {
        "documents": docs,
        "labels": [(d[0], int(d[0] % 4 > 0), int(d[0] % 5 == 0), "r") for d in docs if d[0] is not None and d[0] < 150] + [(1, None, None, "r"), (1, 1, 0, "r"), (9999, 1, 1, "r"), (None, 0, 1, "r")],
        "pages": pages,
        "benchmark": [(1, passage, "w", "w"), (2, "Word", "w", "w"), (3, None, "w", "w"), (4, "?!", "w", "w"), (10, passage.upper(), "w", "w"), (None, docs[20][1], "w", "w"), (5, docs[21][1], "w", "w"), (5, docs[21][1], "w", "w"), (6, "never seen anywhere at all", "w", "w")],
        "conversations": make_conversations(),
        "embeddings": [(i, v, lab, 7, 8) for i, v, lab in vectors + odd],
    }


@pytest.fixture(scope="session")
def tables():
    return make_tables()


def write(spark, folder, tables) -> str:
    for name, rows in tables.items():
        spark.createDataFrame(rows, SCHEMAS[name]).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def messy(spark, tables, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("messy"), tables)


@pytest.fixture(scope="session")
def empty(spark, tables, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {k: [] for k in tables})
