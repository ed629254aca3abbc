"""URL filters: listed rules first, mined association rules for the rest (DataFrame operations only).

A listed rule is a host and the beginning of a path. It fits its host and all
subdomains; of those that fit, the longest decides.

For other URLs, FP-growth mines combinations of URL tokens (labels of the host,
parts of the path, names of query parameters) from labelled URLs. Combinations
that foretell the label `block` are rules if enough rows hold them (a share of
the rows, and a number of them, so that small tables teach no chance finds),
confidently enough, and more confidently than the label itself is common. An
inverted index lists each rule under its rarest token; URLs are joined with the
index on their tokens, and a rule that is found there matches if the URL has all
of its tokens. A URL that a rule matches is blocked, any other is allowed.

All frequent tokens of a URL are combined, whatever their place and number. Where
no URL has more than `max_items`, Spark's FP-growth lists all rules. A longer URL
would alone have 2^tokens combinations, most of them under a rule that is found
already. Then `grow_rules` mines the shortest rules by the same growth, on tables:
those that hold no other rule. As every rule holds one of them, and a URL that has
all tokens of a rule has those of the shorter one, verdicts are the same.

Edge cases: null URLs and those without `://` have empty host and path, hence no
tokens and no rule, and are allowed; URLs that occur often are matched once;
without labels, or without a combination that is frequent enough, there are no
mined rules; rows without a label teach nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import urls
from quillspark.llm.common import BROADCAST_ROWS, hashable, sized_join, sized_rows, whole_row
from quillspark.storage import materialise

#: Share and number of labelled rows that a rule needs, its confidence, and that over the share of blocked rows.
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE, MIN_LIFT = 0.001, 5, 0.6, 1.5
#: Frequent tokens of a URL up to which all rules are listed; where one has more, the shortest are.
MAX_ITEMS = 16
#: Files of a table of tokens or rules, at most.
FILES = 32
BLOCKED = "label:block"


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL, each marked with the part it is from."""
    labels = F.transform(F.filter(F.split(urls.host(url), r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    parts = F.transform(F.filter(F.split(urls.path(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x))
    names = F.transform(urls.query_names(url), lambda x: F.concat(F.lit("query:"), x))
    return F.array_distinct(F.concat(labels, parts, names))


def grow_rules(lists: DataFrame, least: float, is_rule: Column) -> DataFrame:
    """antecedent, n, bad: the shortest rules of `lists` (items, rarest first; n and bad: rows and blocked ones that have just these).

    FP-growth, a level at a time for all sets: `held` is a set, `rest` what lists that
    have it hold of more frequent items, equal ones as one with their sums. A set
    grows while `least` blocked rows have it, it is no rule, and none of its items
    goes without saying (it has fewer rows than each set that is shorter by one).
    Those are all sets below a shortest rule: parts of it are frequent and no rules,
    and if an item of it went without saying, what remains would be a rule.
    """
    rests = materialise(lists.withColumn("held", F.array().cast("array<string>")).withColumnRenamed("items", "rest"), "url-lists")
    found, grown, level = [], None, 1
    while not rests.isEmpty():
        each = rests.select("held", F.explode("rest").alias("item"), "n", "bad").groupBy("held", "item").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        sets = each.filter(F.col("bad") >= least).withColumn("antecedent", F.array_append("held", F.col("item")))
        if grown:
            shorter = F.transform("antecedent", lambda x: F.array_remove(F.col("antecedent"), x))
            known = grown.select(F.col("antecedent").alias("shorter"), F.col("n").alias("most"))
            met = sets.withColumn("shorter", F.explode(shorter)).join(known.hint("merge"), "shorter").filter(F.col("most") > F.col("n"))
            sets = met.groupBy("antecedent", "held", "item", "n", "bad").agg(F.count("*").alias("met")).filter(F.col("met") == level).drop("met")
        sets = materialise(sets.withColumn("rule", is_rule), "url-sets", FILES)
        found.append(sets.filter("rule").select("antecedent", "n", "bad"))
        grown = sets.filter("not rule")
        onward = materialise(grown.groupBy("held").agg(F.collect_list("item").alias("onward")), "url-onward", FILES)
        kept = sized_join(rests, onward, ["held"], "inner", [F.col("rest")], size=sized_rows(onward, F.array_join("onward", ".")))
        kept = kept.select("held", F.array_intersect("rest", "onward").alias("kept"), "n", "bad").filter(F.size("kept") > 1)
        kept = kept.select("held", "kept", "n", "bad", F.posexplode("kept").alias("at", "item")).filter(F.col("at") + 1 < F.size("kept"))
        rests = kept.select(F.array_append("held", F.col("item")).alias("held"), F.slice("kept", F.col("at") + 2, F.size("kept")).alias("rest"), "n", "bad")
        rests = materialise(rests.groupBy("held", "rest").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-lists")
        level += 1
    return reduce(DataFrame.unionAll, found)


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_rows: int = MIN_ROWS, max_items: int = MAX_ITEMS) -> DataFrame:
    """antecedent, confidence, lift, support, token: rules from rows of tokens and block (boolean).

    There are at most (tokens of a URL) / min_support frequent tokens. All rules, or
    the shortest if a URL has more than `max_items` frequent tokens.
    """
    known = labelled.filter("tokens is not null and block is not null").select("tokens", "block", F.monotonically_increasing_id().alias("id"))
    known = materialise(known, "labelled-urls")
    n, blocked = known.agg(F.count("*"), F.count_if("block")).first()
    empty = known.select(F.col("tokens").alias("antecedent"), *[F.lit(0.0).alias(c) for c in ("confidence", "lift", "support")], F.lit("").alias("token")).limit(0)
    if not blocked:
        return materialise(empty, "url-rules", FILES)
    least = max(min_support, min(1.0, min_rows / n)) * n * (1 - 1e-12)
    each = known.select("id", "block", F.explode(F.array_distinct("tokens")).alias("token"))
    common = materialise(each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("block").alias("bad")).filter(F.col("bad") >= least), "url-tokens", FILES)
    own = F.array_sort(F.collect_list(F.struct("n", "token")))["token"]
    held = sized_join(each, common.drop("bad"), ["token"], "inner", [F.col("id")], size=sized_rows(common, F.col("token"))).groupBy("id").agg(F.first("block").alias("block"), own.alias("items"))
    held = materialise(held.select("items", "block"), "url-items")
    rows, longest = held.agg(F.count("*"), F.max(F.size("items"))).first()  # those that hold a frequent token; shares are of all labelled rows
    if not rows:
        return materialise(empty, "url-rules", FILES)
    lift = F.col("confidence") / (blocked / n)
    if longest > max_items:
        lists = held.groupBy("items").agg(F.count("*").alias("n"), F.count_if("block").alias("bad"))
        confidence = F.col("bad") / F.col("n")
        grown = grow_rules(lists, least, (confidence >= min_confidence) & (confidence / (blocked / n) >= min_lift))
        mined = grown.select("antecedent", confidence.alias("confidence"), (F.col("bad") / n).alias("support"))
    else:
        items = held.select(F.when(F.col("block"), F.array_append("items", F.lit(BLOCKED))).otherwise(F.col("items")).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=least / rows, minConfidence=min_confidence).fit(items)
        mined = model.associationRules.filter(F.col("consequent")[0] == BLOCKED).select("antecedent", "confidence", (F.col("support") * rows / n).alias("support"))
    rules = materialise(mined.withColumn("lift", lift).filter(F.col("lift") >= min_lift), "mined-rules", FILES)
    keyed = sized_join(rules.withColumn("token", F.explode("antecedent")), common, ["token"], "inner", [F.col("antecedent")], size=sized_rows(common, F.col("token")))
    rarest = keyed.groupBy("antecedent", "confidence", "lift", "support").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return materialise(rarest, "url-rules", FILES)


def match_rules(pages: DataFrame, rules: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Distinct `url`s of `pages` that a rule matches."""
    each = pages.filter("url is not null").select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    held = sized_join(each.select("url", "tokens", F.explode("tokens").alias("token")), rules, ["token"], "inner", [F.col("url")], rows, size=sized_rows(rules, F.array_join("antecedent", ".")))
    return held.filter(F.size(F.array_except("antecedent", "tokens")) == 0).select("url").distinct()


def listed(url: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct rule, verdict of the longest listed (host, path, verdict) that fits, else null."""
    host, path = urls.host(url), urls.path(url)
    fits = []
    for own_host, own_path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fit = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        fits.append(F.when(fit, F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule: string, verdict: string>")


def judge(df: DataFrame, url: Column, rules: list[tuple[str, str, str]], mined: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Columns row, host, path, rule, verdict, decided_by (listed, mined or default); a row for each of `df`."""
    base = df.select(whole_row(df), url.alias("url"), F.xxhash64(*hashable(df)).alias("hash"), urls.host(url).alias("host"), urls.path(url).alias("path"), listed(url, rules).alias("fit"))
    blocked = materialise(match_rules(base.filter("fit is null"), mined, rows).withColumn("blocked", F.lit(True)), "blocked-urls")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    by = F.when(F.col("fit").isNotNull(), "listed").when(F.col("blocked"), "mined").otherwise("default")
    judged = sized_join(base, blocked, ["url"], "left", [F.col("hash")], rows, size=sized_rows(blocked, F.col("url")))
    return judged.select("row", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), by.alias("decided_by"))
