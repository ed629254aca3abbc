"""Which rows a run takes: named ones, new ones, the first ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only(rows: DataFrame, key: str, wanted: list[str] | None) -> DataFrame:
    """Rows whose key is named; all if none is."""
    return rows.filter(F.col(key).isin(*wanted)) if wanted else rows


def selected_or_all(rows: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """Rows whose key is among the chosen, or all rows if that is none of them."""
    kept = rows.join(chosen.select(key).distinct(), key, "left_semi")
    return rows if kept.isEmpty() else kept


def missing_files(rows: DataFrame, path: str, listing: DataFrame, force: bool = False, partial: tuple[str, ...] = (".part", ".ytdl")) -> DataFrame:
    """Rows whose file isn't listed (path, and length if known) yet.

    Files that are empty or still being written don't count; `force` takes all rows.
    """
    if force:
        return rows
    there = listing
    for suffix in partial:
        there = there.filter(~F.endswith("path", F.lit(suffix)))
    if "length" in listing.columns:
        there = there.filter("length > 0")
    return rows.join(there.select(F.col("path").alias(path)).distinct(), path, "left_anti")


def first(rows: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """The first `n` rows in the order, in it; all rows if `n` is None."""
    if n is None:
        return rows
    if n < 0:
        raise ValueError("a limit can't be negative")
    return rows.orderBy(*order).limit(n)
