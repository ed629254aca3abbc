"""Source manifests: reading, checking, and building one from a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import humanize, resource_type
from quillspark.order import ordinal
from quillspark.storage import materialise

VERSION = "1.0"
#: Kinds of resource and splits that a manifest may name.
RESOURCE_TYPES = ("video_transcript", "documentation", "tutorial", "article", "course_outline", "playlist", "certification_page", "training_portal")
SPLITS = ("train", "eval", "holdout", "unassigned")
SOURCE = (
    "struct<source_id: string, title: string, resource_type: string, original_url: string, local_path: string, "
    "topic_bucket_ids: array<string>, description: string, priority: variant, split: string, notes: string, enabled: variant>"
)
SCHEMA = (
    "manifest_version string, pack_id string, title string, description string, domain string, "
    f"topic_buckets array<struct<id: string, label: string, description: string>>, sources array<{SOURCE}>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each manifest file."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def _when(bad: Column, message: Column) -> Column:
    return F.when(bad, F.array(message)).otherwise(F.array().cast("array<string>"))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def manifest_errors(manifest: DataFrame, missing: Column | None = None, types: tuple[str, ...] = RESOURCE_TYPES) -> Column:
    """Array of everything that is wrong, in the order of the file.

    `missing` is an array of local paths that don't exist; enabled sources must
    not name one.
    """
    head = [_when(blank(F.col(c)), F.lit(f"{c} must be a non-empty string")) for c in ("pack_id", "title", "domain")]
    head.insert(0, _when(~F.col("manifest_version").eqNullSafe(VERSION), F.lit("manifest_version is not supported")))
    buckets = F.coalesce("topic_buckets", F.array().cast("array<struct<id: string, label: string, description: string>>"))
    sources = F.coalesce("sources", F.array().cast(f"array<{SOURCE}>"))
    bucket_ids = F.transform(buckets, lambda b: b["id"])
    source_ids = F.transform(sources, lambda s: s["source_id"])
    gone = missing if missing is not None else F.array().cast("array<string>")

    def bucket_errors(b: Column, i: Column) -> Column:
        at = F.concat(F.lit("topic_buckets["), i.cast("string"), F.lit("]"))
        return F.concat(
            _when(blank(b["id"]), F.concat(at, F.lit(".id must be a non-empty string"))),
            _when(F.array_contains(F.slice(bucket_ids, F.lit(1), i), b["id"]), F.concat(at, F.lit(".id is a duplicate"))),
            _when(blank(b["label"]), F.concat(at, F.lit(".label must be a non-empty string"))),
        )

    def source_errors(s: Column, i: Column) -> Column:
        at = F.concat(F.lit("sources["), i.cast("string"), F.lit("]"))
        say = lambda bad, what: _when(F.coalesce(bad, F.lit(False)), F.concat(at, F.lit(what)))
        ids = F.coalesce(s["topic_bucket_ids"], F.array().cast("array<string>"))
        known = F.transform(bucket_ids, lambda b: F.trim(b))
        split = F.coalesce(F.nullif(F.trim(s["split"]), F.lit("")), F.lit("unassigned"))
        return F.concat(
            say(blank(s["source_id"]), ".source_id must be a non-empty string"),
            say(F.array_contains(F.slice(source_ids, F.lit(1), i), s["source_id"]), ".source_id is a duplicate"),
            say(blank(s["title"]), ".title must be a non-empty string"),
            say(blank(s["resource_type"]) | ~s["resource_type"].isin(*types), ".resource_type is not supported"),
            say(blank(s["local_path"]), ".local_path must be a non-empty string"),
            say(~_kind(s["enabled"]).isin("BOOLEAN", "VOID"), ".enabled must be a boolean"),
            say(F.coalesce(F.try_variant_get(s["enabled"], "$", "boolean"), F.lit(True)) & F.array_contains(gone, s["local_path"]), ".local_path does not exist"),
            say(F.size(ids) == 0, ".topic_bucket_ids must be a non-empty list"),
            say(F.exists(ids, blank), ".topic_bucket_ids must hold non-empty strings"),
            say(F.exists(ids, lambda x: ~blank(x) & ~F.array_contains(known, x)), ".topic_bucket_ids names an unknown bucket"),
            say(~split.isin(*SPLITS), ".split is not supported"),
            say(~_kind(s["priority"]).isin("BIGINT", "BOOLEAN", "VOID"), ".priority must be an integer"),
        )

    return F.concat(
        *head,
        _when(F.size(buckets) == 0, F.lit("topic_buckets must be a non-empty list")),
        F.flatten(F.transform(buckets, bucket_errors)),
        _when(F.size(sources) == 0, F.lit("sources must be a non-empty list")),
        F.flatten(F.transform(sources, source_errors)),
    )


def enabled_sources(manifest: DataFrame) -> DataFrame:
    """A row for each enabled source with its defaults, in order of priority and id."""
    rows = manifest.select("pack_id", F.posexplode("sources").alias("ord", "s")).select("pack_id", "ord", "s.*")
    rows = rows.withColumn("enabled", F.coalesce(F.try_variant_get("enabled", "$", "boolean"), F.lit(True)))
    rows = rows.withColumn("priority", F.coalesce(F.try_variant_get("priority", "$", "int"), F.lit(100)))
    rows = rows.withColumn("split", F.coalesce(F.nullif(F.trim("split"), F.lit("")), F.lit("unassigned")))
    return rows.filter("enabled").orderBy("priority", "source_id")


def with_existing(sources: DataFrame, listing: DataFrame) -> DataFrame:
    """Sources with skipped and skip_reason by whether their file is listed (path)."""
    there = listing.select(F.col("path").alias("local_path"), F.lit(True).alias("_there")).distinct()
    out = sources.join(there, "local_path", "left").withColumn("skipped", F.col("_there").isNull())
    return out.withColumn("skip_reason", F.when(F.col("skipped"), F.concat(F.lit("missing file: "), "local_path"))).drop("_there")


def folder_sources(files: DataFrame, buckets: list[str], split: str = "unassigned") -> DataFrame:
    """Manifest rows of files (path, relative to their folder), in the order of path parts.

    The first holder of a name keeps it as its id; later ones add four digits of a
    hash of their path, and should these clash, of more hashes.
    """
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)
    base = files.select("path", stem.alias("stem"), F.regexp_extract(name, r"(\.[^./]+)$", 1).alias("suffix"))
    base = base.withColumn("base", F.regexp_replace(F.regexp_replace(F.lower("stem"), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""))
    base = base.withColumn("base", F.when(F.col("base") == "", "file").otherwise(F.col("base")))
    order = F.split("path", "/")
    placed = ordinal(base, [order], "_ordinal").withColumn("priority", (F.col("_ordinal") + 1).cast("int"))
    # A name such as `index` may be that of very many files: its first holder is found by a sum, and joined by its place.
    placed = materialise(placed, "placed-files")
    firsts = placed.groupBy("base").agg(F.min("priority").alias("priority")).select("priority", F.lit(1).alias("_n"))
    rows = placed.join(firsts, "priority", "left").withColumn("_n", F.coalesce("_n", F.lit(2)))
    digits = F.substring(F.sha2("path", 256), 1, 4)
    rows = rows.withColumns({"_digits": digits, "source_id": F.when(F.col("_n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), digits))})
    for size in (4, 4, 16):  # those that clash hash again, and should that not be enough, to more digits
        clash = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("_n") > 1, "priority")) > 1
        again = F.substring(F.sha2(F.concat("path", F.lit(":"), "_digits"), 256), 1, size)
        rows = rows.withColumn("_clash", clash).withColumn("_digits", F.when(F.col("_clash"), again).otherwise(F.col("_digits")))
        rows = rows.withColumn("source_id", F.when(F.col("_clash"), F.concat("base", F.lit("_"), "_digits")).otherwise(F.col("source_id")))
    return rows.select(
        "source_id", humanize(F.col("stem")).alias("title"), resource_type(F.col("suffix")).alias("resource_type"),
        F.col("path").alias("local_path"), F.array(*map(F.lit, buckets)).alias("topic_bucket_ids"), "priority", F.lit(split).alias("split"), F.lit(True).alias("enabled"),
    )


def append_sources(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifest, one row, with the sources `rows` after its own; fields that a manifest lacks are left out."""
    kind = manifest.schema["sources"].dataType.elementType
    given = {f.name: f.dataType for f in rows.schema.fields}
    fields = [F.col(f.name).cast(f.dataType) if f.name in given else F.lit(None).cast(f.dataType) for f in kind.fields]
    order = F.coalesce(F.col("priority").cast("long"), F.lit(100)) if "priority" in given else F.lit(100)
    own = F.struct(*[c.alias(f.name) for c, f in zip(fields, kind.fields, strict=True)])
    made = rows.select(order.alias("o"), F.col("source_id").alias("k"), own.alias("s"))
    listed = F.sort_array(F.collect_list(F.struct("o", "k", F.to_json("s").alias("j"))))
    added = made.agg(F.from_json(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["j"]), ","), F.lit("]")), f"array<{SOURCE}>").alias("_added"))
    # Both sides are one row, as a manifest is.
    both = manifest.withColumn("_one", F.lit(1)).join(added.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    none = F.array().cast(f"array<{SOURCE}>")
    return both.withColumn("sources", F.concat(F.coalesce("sources", none), F.coalesce("_added", none))).drop("_added")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Write manifests back as JSON, one line each."""
    manifest.coalesce(1).write.mode("overwrite").json(path)
