"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a hashed word vector beside the mean of its hashed character
n-gram vectors. Two gated recurrent layers read a window from both ends,
attention weighs their states, and a linear layer gives the window's logit. A
text is read whole, in overlapping windows, and scored by its highest window.

Labels belong to documents, so training looks at several windows of a document:
the highest must be toxic if the document is, and none may be if it isn't. Every one
of a fixed number of steps sees documents of both classes. Part of the sample
doesn't train; on it the bias is moved so that a score of 0.5 parts the classes
best, a false alarm counting `ALARM` times as much as a miss.

The network is fitted on a bounded sample: `max_docs` labelled documents of
either class in expectation, chosen by a hash of the id; of rows that share an
id, one text teaches. What each step looks at
is drawn from all windows of these documents before training, by their numbers
of windows, and only what is drawn comes to the driver: the steps bound it, not
the texts. The part that sets the level is scored on executors, whole.

Edge cases: null, empty and wordless texts score 0; without labels of both
classes all scores are 0; of contradicting labels the toxic one counts;
repeated rows are scored alike.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.storage import materialise

WORD = re.compile(r"[^\W\d_]+")
#: Words of a window, and from one window's beginning to the next.
WINDOW, STRIDE = 48, 36
WORD_BUCKETS, CHAR_BUCKETS = 1 << 12, 1 << 13
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 16, 8, 8
ORDERS = (3, 4)
MAX_DOCS = 2500
STEPS, DOCS_A_STEP, WINDOWS_A_STEP, RATE = 500, (18, 10), 4, 0.01
#: One in so many sampled documents sets the level of the scores and doesn't train.
HELD_FOR_LEVEL = 6
#: What a false alarm costs, in misses, when the level is set.
ALARM = 2
#: Distinct words and windows that are worked on at once.
WORDS_AT_ONCE, WINDOWS_AT_ONCE = 20_000, 2048
#: Characters of a text that are split into words at once.
PIECE_CHARS = 1 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def starts_of(n: int) -> np.ndarray:
    """Where the windows over n words begin."""
    return np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE)[: 1 + max(0, -(-(n - WINDOW) // STRIDE))]


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets; character n-gram buckets and the word of each, sorted by word."""
    raw = [w.encode() for w in words]
    own = np.array([zlib.crc32(r) for r in raw], np.int64) % WORD_BUCKETS
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(sizes), sizes)
    whose = np.repeat(np.arange(len(words)), sizes)
    grams, owners = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        h = np.full(m, 2166136261 + n, np.uint32)
        for k in range(n):
            h = (h ^ points[k : k + m]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
        inside = np.arange(m) + n <= ends[:m]
        grams.append((h[inside] % CHAR_BUCKETS).astype(np.int64))
        owners.append(whose[:m][inside])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return own, grams[order], owners[order]


def features(net: dict, words: list[str]) -> np.ndarray:
    own, grams, owners = hashed(words)
    begin = np.searchsorted(owners, np.arange(len(words)))
    count = np.bincount(owners, minlength=len(words))[:, None]
    chars = np.add.reduceat(net["chars"][grams], begin, axis=0) / count
    return np.concatenate((net["words"][own], chars.astype(np.float32)), axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def recur(p: np.ndarray, u: np.ndarray, mask: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States (time, windows, HIDDEN) of one direction over the projected inputs p."""
    t_all, n, _ = p.shape
    h, out = np.zeros((n, HIDDEN), np.float32), np.empty((t_all, n, HIDDEN), np.float32)
    for t in range(t_all - 1, -1, -1) if back else range(t_all):
        hu = h @ u
        gates = sigmoid(p[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r, hun = gates[:, :HIDDEN], gates[:, HIDDEN:], hu[:, 2 * HIDDEN :]
        c = np.tanh(p[t, :, 2 * HIDDEN :] + r * hun)
        new = c + z * (h - c)
        m = mask[t][:, None]
        if keep is not None:
            keep.append((t, h, z, r, c, hun, m))
        h = new if m.all() else np.where(m, new, h)
        out[t] = h
    return out


def pool(net: dict, hs: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    act = np.tanh(hs @ net["att"] + net["att_b"])
    s = np.where(mask, act @ net["att_v"], np.float32(-1e9))
    e = np.exp(s - s.max(axis=0))
    alpha = e / e.sum(axis=0)
    c = (alpha[:, :, None] * hs).sum(axis=0)
    return act, alpha, c, c @ net["out"] + net["out_b"]


def new_net(rng: np.random.Generator) -> dict:
    dim = WORD_DIM + CHAR_DIM
    make = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    net = {"words": make(WORD_BUCKETS, WORD_DIM, scale=0.1), "chars": make(CHAR_BUCKETS, CHAR_DIM, scale=0.3)}
    for d in "fb":
        net |= {f"w{d}": make(dim, 3 * HIDDEN, scale=dim**-0.5), f"u{d}": make(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    net |= {"att": make(2 * HIDDEN, ATTENTION, scale=0.3), "att_b": np.zeros(ATTENTION, np.float32), "att_v": make(ATTENTION, scale=0.3), "out": make(2 * HIDDEN, scale=0.3), "out_b": np.zeros(1, np.float32)}
    return net


def gradient(net: dict, index: np.ndarray, mask: np.ndarray, vocab: tuple, loss_of) -> tuple[float, dict]:
    """Loss and gradient for windows of words; vocab is what `hashed` says of the words."""
    own, grams, owners = vocab
    n_words = len(own)
    begin, count = np.searchsorted(owners, np.arange(n_words)), np.bincount(owners, minlength=n_words)[:, None]
    x = np.concatenate((net["words"][own], np.add.reduceat(net["chars"][grams], begin, axis=0) / count), axis=1).astype(np.float32)
    kept, states = {}, []
    for d in "fb":
        kept[d] = []
        states.append(recur((x @ net[f"w{d}"] + net[f"b{d}"])[index], net[f"u{d}"], mask, d == "b", kept[d]))
    hs = np.concatenate(states, axis=2)
    act, alpha, c, logit = pool(net, hs, mask)
    loss, dlogit = loss_of(logit)
    g = {"out": c.T @ dlogit, "out_b": dlogit.sum(keepdims=True)}
    dc = dlogit[:, None] * net["out"]
    dalpha = (hs * dc).sum(axis=2)
    dhs = alpha[:, :, None] * dc
    ds = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
    g["att_v"] = np.einsum("tn,tna->a", ds, act)
    dact = ds[:, :, None] * net["att_v"] * (1 - act * act)
    g["att"], g["att_b"] = np.einsum("tnh,tna->ha", hs, dact), dact.sum(axis=(0, 1))
    dhs += dact @ net["att"].T
    dx = np.zeros_like(x)
    for k, d in enumerate("fb"):
        own_dhs, u = dhs[:, :, k * HIDDEN : (k + 1) * HIDDEN], net[f"u{d}"]
        dp, du, dh = np.zeros((*index.shape, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((index.shape[1], HIDDEN), np.float32)
        for t, before, z, r, cand, hun, m in reversed(kept[d]):
            dh = dh + own_dhs[t]
            new = dh * m
            da = new * (1 - z) * (1 - cand * cand)
            dz = new * (before - cand) * z * (1 - z)
            dr = da * hun * r * (1 - r)
            gate = np.concatenate((dz, dr, da * r), axis=1)
            dp[t] = np.concatenate((dz, dr, da), axis=1)
            du += before.T @ gate
            dh = new * z + dh * ~m + gate @ u.T
        flat, at = dp.reshape(-1, 3 * HIDDEN), index.reshape(-1)
        dproj = np.stack([np.bincount(at, flat[:, j], n_words) for j in range(3 * HIDDEN)], axis=1)
        g[f"w{d}"], g[f"u{d}"], g[f"b{d}"] = x.T @ dproj, du, flat.sum(axis=0)
        dx += (dproj @ net[f"w{d}"].T).astype(np.float32)
    g["words"] = np.stack([np.bincount(own, dx[:, j], WORD_BUCKETS) for j in range(WORD_DIM)], axis=1)
    dchar = (dx[:, WORD_DIM:] / count)[owners]
    g["chars"] = np.stack([np.bincount(grams, dchar[:, j], CHAR_BUCKETS) for j in range(CHAR_DIM)], axis=1)
    return loss, g


def draws(sizes: tuple[list[int], list[int]], steps: int, seed: int = 7) -> tuple[dict, list[list[tuple[int, int, np.ndarray]]]]:
    """A new network, and for each step the label, place and windows of its documents.

    sizes: the number of windows of each document, by label.
    """
    rng = np.random.default_rng(seed)
    net, planned = new_net(rng), []
    for _ in range(steps):
        planned.append([])
        for k in (0, 1):
            for i in rng.integers(len(sizes[k]), size=DOCS_A_STEP[k]):
                planned[-1].append((k, int(i), rng.permutation(sizes[k][i])[:WINDOWS_A_STEP]))
    return net, planned


def train(docs: list[tuple[int, list[list[str]]]], steps: int = STEPS, seed: int = 7) -> dict | None:
    """A network from documents of (label, windows); None unless both classes are there."""
    held = [(label, w) for label, w in docs[::HELD_FOR_LEVEL] if w]
    sides = [[w for i, (label, w) in enumerate(docs) if label == k and w and i % HELD_FOR_LEVEL] for k in (0, 1)]
    if not all(sides):
        return None
    net, planned = draws(tuple([len(w) for w in side] for side in sides), steps, seed)
    net = learn(net, planned, lambda k, i, j: sides[k][i][j])
    return level(net, [label for label, _ in held], [score_words(net, w).max() for _, w in held])


def learn(net: dict, planned: list[list[tuple[int, int, np.ndarray]]], window) -> dict:
    """The network after the planned steps; `window` gives the words of (label, place, window)."""
    steps = len(planned)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    for step, seen in enumerate(planned, 1):
        windows, of, labels = [], [], []
        for k, i, picked in seen:
            windows += [window(k, i, int(j)) for j in picked]
            of += [len(labels)] * len(picked)
            labels.append(k)
        names = sorted({w for win in windows for w in win})
        place = {w: i for i, w in enumerate(names)}
        index, mask = np.zeros((WINDOW, len(windows)), np.int64), np.zeros((WINDOW, len(windows)), bool)
        for j, win in enumerate(windows):
            index[: len(win), j], mask[: len(win), j] = [place[w] for w in win], True
        of_a, labels_a = np.array(of), np.array(labels)

        def loss_of(logit: np.ndarray, of_a=of_a, labels_a=labels_a) -> tuple[float, np.ndarray]:
            p = sigmoid(logit)
            d = np.zeros_like(logit)
            loss = 0.0
            for i, label in enumerate(labels_a):
                at = np.flatnonzero(of_a == i)
                if label:
                    at = at[[logit[at].argmax()]]
                d[at] = (p[at] - label) / len(at) / len(labels_a)
                loss -= np.log(np.abs(1 - label - p[at]) + 1e-9).mean() / len(labels_a)
            return loss, d

        _, grad = gradient(net, index, mask, hashed(names), loss_of)
        rate = RATE * min(1, step / 30) * (1 - 0.9 * step / steps)
        for k, v in net.items():
            m, s = moment[k]
            m += 0.1 * (grad[k] - m)
            s += 0.01 * (grad[k] ** 2 - s)
            v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def level(net: dict, labels: list[int], scores: list[float]) -> dict:
    """The network with its bias moved to where scores of whole documents part best."""
    if len(set(labels)) < 2:
        return net
    toxic = np.array(labels) == 1
    p = np.array(scores).clip(1e-6, 1 - 1e-6)
    logit = np.log(p / (1 - p))
    cuts = np.sort(logit)
    cuts = np.concatenate(((cuts[1:] + cuts[:-1]) / 2, [0.0]))
    cost = np.array([ALARM * (logit[~toxic] >= c).mean() + (logit[toxic] < c).mean() for c in cuts])
    best = cuts[cost <= cost.min() + 1e-12]
    return net | {"out_b": net["out_b"] - np.float32((best.min() + best.max()) / 2)}


def score_texts(net: dict | None, texts: list[str | None]) -> np.ndarray:
    """The highest window's probability for each whole text."""
    out = np.zeros(len(texts))
    if net is None:
        return out
    held: list[list[str]] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, owner, size
        if held:
            np.maximum.at(out, np.array(owner), score_words(net, held))
        held, owner, size = [], [], 0

    for i, text in enumerate(texts):
        words = words_of(text)
        step = STRIDE * (PIECE_CHARS // (8 * STRIDE))
        for a in range(0, max(len(words) - (WINDOW - STRIDE), 1), step):  # long texts go on where a window begins
            own = words[a : a + step + WINDOW - STRIDE]
            if own:
                held.append(own)
                owner.append(i)
                size += len(own)
            if size >= PIECE_CHARS // 8:
                flush()
    flush()
    return out


def score_words(net: dict, docs: list[list[str]]) -> np.ndarray:
    """The highest probability over the windows of each list of words."""
    flat = [w for d in docs for w in d]
    place = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.array([place[w] for w in flat])
    names = list(place)
    projected = {d: np.empty((len(names), 3 * HIDDEN), np.float32) for d in "fb"}
    for a in range(0, len(names), WORDS_AT_ONCE):
        x = features(net, names[a : a + WORDS_AT_ONCE])
        for d in "fb":
            projected[d][a : a + WORDS_AT_ONCE] = x @ net[f"w{d}"] + net[f"b{d}"]
    sizes = np.array([len(d) for d in docs])
    begin = np.cumsum(sizes) - sizes
    each = [starts_of(n) for n in sizes]
    of = np.repeat(np.arange(len(docs)), [len(s) for s in each])
    start = np.concatenate(each) + begin[of]
    end = (begin + sizes)[of]
    out = np.zeros(len(docs))
    for a in range(0, len(of), WINDOWS_AT_ONCE):
        at = start[a : a + WINDOWS_AT_ONCE] + np.arange(WINDOW)[:, None]
        mask = at < end[a : a + WINDOWS_AT_ONCE]
        index = ids[np.where(mask, at, 0)]
        hs = np.concatenate([recur(projected[d][index], net[f"u{d}"], mask, d == "b") for d in "fb"], axis=2)
        np.maximum.at(out, of[a : a + WINDOWS_AT_ONCE], sigmoid(pool(net, hs, mask)[3]))
    return out


def count_windows(batches):
    """The number of windows of each document of a task."""
    for batch in batches:
        sizes = [len(words_of(t)) for t in batch["text"]]
        yield batch[["label", "h", "key"]].assign(n=[len(starts_of(n)) if n else 0 for n in sizes])


def pick_windows(batches, wanted: dict[int, list[int]]):
    """The wanted windows of each document of a task."""
    for batch in batches:
        rows = []
        for key, text in zip(batch["key"], batch["text"], strict=True):
            if key in wanted:
                words = words_of(text)
                rows += [(key, j, " ".join(words[j * STRIDE : j * STRIDE + WINDOW])) for j in wanted[key]]
        yield pd.DataFrame(rows, columns=["key", "j", "words"])


def rate_whole(batches, net: dict, held: set[int]):
    """The scores of the held documents of a task, each read whole."""
    for batch in batches:
        own = batch[batch["key"].isin(held)]
        yield own[["label", "h", "key"]].assign(score=score_texts(net, list(own["text"])))


def fit(docs: DataFrame, row_id: Column, text: Column, labels: DataFrame, max_docs: int = MAX_DOCS, steps: int = STEPS) -> dict | None:
    """A network from `docs` and `labels` (row_id, label: 0 or 1, one row for an id)."""
    known = labels.filter("label in (0, 1)").select("row_id", "label", F.xxhash64(F.col("row_id").cast("string"), F.lit("toxic")).alias("h"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    share = F.when(F.col("label") == 1, min(1.0, max_docs / max(1, sizes.get(1, 0)))).otherwise(min(1.0, max_docs / max(1, sizes.get(0, 0))))
    picked = materialise(known.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)), "toxic-sample")  # 2 x max_docs rows, which bounds the broadcast
    rows = docs.select(row_id.alias("row_id"), text.alias("text")).join(F.broadcast(picked), "row_id")
    one = F.min(F.struct(F.xxhash64("h", "text").alias("key"), "text")).alias("t")
    rows = materialise(rows.groupBy("label", "h").agg(one).select("label", "h", "t.key", "t.text"), "toxic-texts")  # 2 x max_docs rows, read three times
    counted = rows.mapInPandas(count_windows, "label int, h long, key long, n long").collect()  # numbers of 2 x max_docs rows
    order = sorted((r["h"], r["label"], r["key"], r["n"]) for r in counted)
    held = {key for _, _, key, _ in order[::HELD_FOR_LEVEL]}
    sides = [[(key, n) for _, label, key, n in order if label == k and n and key not in held] for k in (0, 1)]
    if not all(sides):
        return None
    net, planned = draws(tuple([n for _, n in side] for side in sides), steps)
    wanted: dict[int, set[int]] = {}
    for k, i, windows in (x for seen in planned for x in seen):
        wanted.setdefault(sides[k][i][0], set()).update(windows.tolist())
    asked = {key: sorted(js) for key, js in wanted.items()}
    found = rows.mapInPandas(lambda it: pick_windows(it, asked), "key long, j long, words string").collect()  # the steps' windows at most
    drawn = {(r["key"], r["j"]): r["words"] for r in found}
    net = learn(net, planned, lambda k, i, j: drawn[sides[k][i][0], j].split(" "))
    wordy = {key for _, _, key, n in order if n} & held
    rated = sorted(map(tuple, rows.mapInPandas(lambda it: rate_whole(it, net, wordy), "label int, h long, key long, score double").collect()))
    return level(net, [label for label, *_ in rated], [score for *_, score in rated])


def predict(spark, text: Column, net: dict | None) -> Column:
    """Score from 0 to 1 for the whole text."""
    shared = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(shared.value, list(texts)))

    return run(text)
