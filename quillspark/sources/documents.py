"""Documents as JSON, with a version that must fit and no unknown fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.chunking import SECTION

VERSION = "1.0"
REQUIRED = ("document_id", "source_type", "source_path", "modality", "content_type", "ingestor", "method", "sections")
OPTIONAL = ("title", "language", "format_metadata", "schema_version", "created_at")
SCHEMA = (
    "document_id string, source_type string, source_path string, modality string, content_type string, ingestor string, method string, "
    f"sections array<{SECTION}>, title string, language string, format_metadata variant, schema_version string, created_at string"
)
SECTION_FIELDS = tuple(f.split(": ")[0] for f in SECTION[len("struct<") : -1].split(", "))


class SchemaVersionError(ValueError):
    """The document was written under another version."""


def document_errors(raw: Column) -> Column:
    """Array of errors of a document's JSON text."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    doc = F.from_json(raw, "document_id string, schema_version string, sections array<string>")
    say = lambda names, what: F.transform(names, lambda k: F.concat(F.lit(f"{what} key: "), k))
    array = lambda values: F.array(*map(F.lit, values))

    def section_errors(own: Column, i: Column) -> Column:
        got = F.coalesce(F.json_object_keys(own), none)
        at = F.concat(F.lit("sections["), i.cast("string"), F.lit("]: "))
        index = F.get_json_object(own, "$.index")
        bad = F.array_compact(F.array(F.when(~F.coalesce(index.rlike(r"^\d+$"), F.lit(False)), "index must be an integer of at least 0"), F.when(F.get_json_object(own, "$.text").isNull(), "text must be a string")))
        return F.transform(F.concat(say(F.array_except(got, array(SECTION_FIELDS)), "unknown"), bad), lambda e: F.concat(at, e))

    version = F.when(~doc["schema_version"].eqNullSafe(VERSION), F.array(F.lit("schema_version is not supported"))).otherwise(none)
    rest = F.concat(
        say(F.array_except(keys, array((*REQUIRED, *OPTIONAL))), "unknown"), say(F.array_except(array(REQUIRED), keys), "missing"),
        F.when(F.coalesce(F.trim(doc["document_id"]), F.lit("")) == "", F.array(F.lit("document_id must be a non-empty string"))).otherwise(none),
        F.coalesce(F.flatten(F.transform(doc["sections"], section_errors)), none),
    )
    return F.when(F.size(version) > 0, version).otherwise(rest)


def load_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents of JSON files, one each, or one a line; the first bad one is an error."""
    raw = spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("file"), "value")
    checked = raw.withColumn("errors", document_errors(F.col("value")))
    bad = checked.filter(F.size("errors") > 0).select("file", "errors").first()
    if bad:
        message = f"{bad['file']}: {bad['errors'][0]}"
        raise SchemaVersionError(message) if bad["errors"][0].startswith("schema_version") else ValueError(message)
    return checked.select(F.from_json("value", SCHEMA).alias("d")).select("d.*")


def save_documents(docs: DataFrame, path: str, folders: bool = True) -> None:
    """JSON below `path`, in a folder for each document; without folders, as lines of as many files as there are tasks, for large corpora."""
    if not folders:
        docs.write.mode("overwrite").json(path)
        return
    docs.withColumn("document", F.col("document_id")).repartition("document").write.mode("overwrite").partitionBy("document").json(path)
