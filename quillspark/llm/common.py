"""Column helpers that the corpus operators share.

Operators carry a whole input row as one struct column, `row`, beside their own
columns, so an input may have any further columns under any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, and all of ASCII that is neither letter nor digit.
SPACES = "\t\n\x0b\x0c\r"
MARKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Rows of a table that may be broadcast at most, unless an operator says otherwise: some 20 MB of numbers.
BROADCAST_ROWS = 200_000
#: Bytes of text that count as a row where a table holds texts.
ROW_BYTES = 100
#: Shares of a key's rows that meet in different tasks when a table is too large to broadcast.
SALTS = 8


def cut(text: Column) -> Column:
    """What stands between the spaces of a text; one translation and one split cost a tenth of matching words."""
    return F.array_remove(F.split(text, " "), "")


def space_words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return cut(F.translate(text, SPACES, " " * len(SPACES)))


def alnum_words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all that is not ASCII, A-Z lower-cased."""
    return cut(F.translate(text, UPPER + MARKS, LOWER + " " * len(MARKS)))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.size(space_words(text)), F.lit(0)).cast("long")


def sized_rows(df: DataFrame, text: Column) -> int:
    """Rows of `df`, each counted once for every ROW_BYTES bytes of its text that it begins."""
    return df.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / ROW_BYTES)))).first()[0] or 0


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str, spread: list[Column], rows: int = BROADCAST_ROWS, salts: int = SALTS, size: int | None = None) -> DataFrame:
    """`left` joined with the written table `right`, which is broadcast if it has `rows` rows at most (or `size` says so).

    Beyond that both are shuffled by key and by a share of the key, which `spread`
    decides for the rows of `left`; so a hot key meets in `salts` tasks. The hint
    keeps Spark from broadcasting the copies after all, as their files are small:
    a million numbers are 5 MB of Parquet, their copies in the driver 700 MB.
    """
    if (right.count() if size is None else size) <= rows:
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def whole_row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def hashable(df: DataFrame) -> list[Column]:
    """All columns as they can be hashed: those that hold maps or variants as JSON."""
    own = [(F.col(f"`{f.name}`"), f.dataType.simpleString()) for f in df.schema.fields]
    return [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c for c, kind in own]


def row_keys(row_id: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes of id and text, never null: rows equal in both share them."""
    return [F.xxhash64(row_id, text).alias("k1"), F.xxhash64(text, F.lit("2"), row_id).alias("k2")]


def seeded_key(seed: int, row_id: Column, tie: Column) -> Column:
    """A uniform hex string that orders rows at random, the same in every run; rows that differ in id or `tie` differ in it."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(row_id.cast("string"), F.lit("")), F.coalesce(tie.cast("string"), F.lit(""))))
