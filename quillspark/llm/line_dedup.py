"""Line dedup by site-relative frequency.

Pages are grouped by host. A line that more than `ratio` of the host's pages
hold is boilerplate there and is dropped from all of them. A line that one page
alone holds isn't repeated, so a host of one page keeps its lines.

Lines are counted under (host, digest of the line), each once for a page, and
summed up before the shuffle; no host meets in one task. A host has at most
(distinct lines of its mean page) / ratio boilerplate lines, which is what is
sent back to its pages: broadcast while all hosts' lines are few enough, and to
shares of a host's pages beyond that.

Edge cases: null URLs share the empty host; null html has no lines; lines are
compared without white space around them; repeated pages count each; a page may
lose all of its lines and stays with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_ROWS, hashable, sized_join, whole_row
from quillspark.storage import materialise

RATIO = 0.5


def drop_boilerplate(df: DataFrame, host: Column, lines: Column, ratio: float = RATIO, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Columns row, host, lines, kept; a row for each of `df`.

    `lines` is evaluated twice: write it first if it is costly.
    """
    host = F.coalesce(host, F.lit(""))
    sites = materialise(df.groupBy(host.alias("host")).agg(F.count("*").alias("pages")).filter("pages > 1"), "sites")
    seen = df.select(host.alias("host"), F.explode(F.array_distinct(lines)).alias("line")).groupBy("host", F.md5("line").alias("digest")).agg(F.count("*").alias("n"))
    often = sized_join(seen.filter("n > 1"), sites, ["host"], "inner", [F.col("digest")], rows).filter(F.col("n") > ratio * F.col("pages"))
    often = materialise(often.select("host", "digest"), "boilerplate-lines")
    common = materialise(often.groupBy("host").agg(F.collect_set("digest").alias("common")), "boilerplate")
    base = df.select(whole_row(df), F.xxhash64(*hashable(df)).alias("hash"), host.alias("host"), lines.alias("lines"))
    joined = sized_join(base, common, ["host"], "left", [F.col("hash")], rows, size=often.count())
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("common", F.md5(x))))
    return joined.select("row", "host", "lines", kept.alias("kept"))
