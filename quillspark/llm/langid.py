"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams are summed over the cluster, their log-probabilities
(languages x buckets) are broadcast, and batches of texts are scored in numpy as
one sparse product: the n-grams of all texts of a piece are looked up at once
and summed text by text. Texts are read whole.

The classifier is fitted on a bounded sample: `max_rows` labelled rows of each
language in expectation, chosen by a hash of the id; a language with fewer is
taken whole, so it is learned however small its share. Null languages and the
held-out fold teach nothing.

Edge cases: null text and text without a letter give `und` with score 0; with
nothing to learn from every text is `und`; a tie goes to the language that sorts
first; repeated rows are scored alike; more than `MAX_LANGS` languages are an
error.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
ORDERS, BUCKETS = (1, 2, 3), 1 << 15
MAX_ROWS = 6000
#: Languages that are learned at most; more are an error, as the model is languages x buckets.
MAX_LANGS = 1000
#: Characters that are hashed at once, which bounds the memory of a task.
PIECE_CHARS = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


def grams(points: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams over lower-cased code points (0: not a letter), and where each begins.

    n-grams that hold nothing but gaps are left out, and so are those that reach
    beyond the end of the text that they begin in, if `ends` tells it for each place.
    """
    places, found = [], []
    for n in ORDERS:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        h = np.full(m, 2166136261 + n, np.uint32)
        some = np.zeros(m, bool)
        for k in range(n):
            own = points[k : k + m]
            h = (h ^ own) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
            some |= own != 0
        if ends is not None:
            some &= np.arange(n, n + m) <= ends[:m]
        at = np.flatnonzero(some)
        places.append(at)
        found.append((h[at] * np.uint32(2654435761)) >> np.uint32(17))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(places)


def letters_of(low: int = 0, high: int = 0x250) -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(low, high)])


IS_LETTER = letters_of()


def code_points(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    small = points < len(IS_LETTER)
    return np.where(small & ~IS_LETTER[np.where(small, points, 0)], np.uint32(0), points)


def pieces(texts: list[str]):
    """(n-gram buckets, number of the text of each) in pieces of bounded size."""
    reach = max(ORDERS) - 1
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def together() -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in held])
        found, places = grams(np.concatenate(held), np.repeat(np.cumsum(sizes), sizes))
        return found, np.repeat(owners, sizes)[places]

    for i, text in enumerate(texts):
        points = code_points(text)
        if len(points) > PIECE_CHARS:  # by itself, cut so that an n-gram counts where it begins
            for a in range(0, len(points), PIECE_CHARS):
                found, places = grams(points[a : a + PIECE_CHARS + reach])
                yield found[places < PIECE_CHARS], np.full(int((places < PIECE_CHARS).sum()), i)
            continue
        held.append(points)
        owners.append(i)
        size += len(points)
        if size >= PIECE_CHARS:
            yield together()
            held, owners, size = [], [], 0
    if held:
        yield together()


def sum_by_text(texts: list[str], table: np.ndarray) -> np.ndarray:
    """For each text, the sum of `table`'s rows over its n-grams."""
    out = np.zeros((len(texts), table.shape[1]))
    for found, owner in pieces(texts):
        for c in range(table.shape[1]):
            out[:, c] += np.bincount(owner, table[found, c], len(texts))
    return out


def count_grams(batches, langs: list[str]):
    """A count of n-grams for each language and bucket that a task has seen."""
    counts = np.zeros((len(langs), BUCKETS), np.int64)
    number = {lang: i for i, lang in enumerate(langs)}
    for batch in batches:
        for lang, group in batch.groupby("lang"):
            for found, _ in pieces(list(group["text"])):
                counts[number[lang]] += np.bincount(found, minlength=BUCKETS)
    of, bucket = np.nonzero(counts)
    if len(of):  # a task may see no row of the sample
        yield pd.DataFrame({"lang": [langs[i] for i in of], "bucket": bucket.astype("int32"), "n": counts[of, bucket]})


def fit(df: DataFrame, text: Column, lang: Column, usable: Column, row_id: Column, max_rows: int = MAX_ROWS, alpha: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities by bucket; the last row of the matrix is the prior."""
    rows = df.select(text.alias("text"), lang.alias("lang"), F.xxhash64(row_id.cast("string"), F.lit("sample")).alias("h"), usable.alias("usable")).filter("usable and lang is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("text").alias("n_texts")).limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    sizes = {r["lang"]: r["n"] for r in found}
    if not sizes:
        return [], np.zeros((BUCKETS + 1, 0))
    langs, total = sorted(sizes), sum(sizes.values())
    sample = rows.filter("text is not null")
    large = [(F.lit(r["lang"]), F.lit(int(max_rows / r["n_texts"] * (1 << 30)))) for r in found if r["n_texts"] > max_rows]
    if large:
        below = F.create_map(*[x for pair in large for x in pair])[F.col("lang")]
        sample = sample.filter(F.pmod("h", F.lit(1 << 30)) < F.coalesce(below, F.lit(1 << 30)))
    partial = sample.select("text", "lang").mapInPandas(lambda it: count_grams(it, langs), "lang string, bucket int, n long")
    counts = np.full((BUCKETS, len(langs)), alpha)
    summed = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    counts[summed["bucket"].to_numpy(), [langs.index(x) for x in summed["lang"]]] += summed["n"].to_numpy()
    prior = np.log(np.array([[sizes[x] / total for x in langs]]))
    return langs, np.vstack([np.log(counts / counts.sum(axis=0)), prior]).astype(np.float32)


def score(texts: pd.Series, langs: list[str], table: np.ndarray) -> pd.DataFrame:
    whole = ["" if t is None else t for t in texts]
    rated = np.array([bool(langs) and LETTER.search(t) is not None and any(c.isalpha() for c in t) for t in whole], bool)
    best, sure = np.full(len(whole), UNDETERMINED, object), np.zeros(len(whole))
    if rated.any():
        at = np.flatnonzero(rated)
        logs = sum_by_text([whole[i] for i in at], table[:-1]) + table[-1]
        logs -= logs.max(axis=1, keepdims=True)
        top = logs.argmax(axis=1)
        best[at] = np.array(langs, object)[top]
        sure[at] = 1 / np.exp(logs).sum(axis=1)
    return pd.DataFrame({"lang_pred": best, "score": sure})


def predict(spark, text: Column, model: tuple[list[str], np.ndarray]) -> Column:
    """A struct lang_pred, score for the whole text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return score(texts, *shared.value)

    return run(text)


def held_out(row_id: Column, folds: int = 5) -> Column:
    """True for rows that nothing is learned from: crc32 of the id as text leaves no remainder; null ids are held out."""
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % folds == 0, F.lit(True))
