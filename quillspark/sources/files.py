"""Files: listing, routing by suffix, decoding, and readers that plug in.

Folders are listed level by level, each by the task that gets it, so names that
begin with `_` are seen and no list of all files meets on the driver. Bytes are
read on the executors, a file at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.text import MEDIA_SUFFIXES
from quillspark.operators.chunking import SECTION
from quillspark.sources import datasource
from quillspark.sources import sections as S
from quillspark.storage import arrow_filesystem, materialise

#: Names that file managers leave behind.
JUNK = ("Thumbs.db", ".DS_Store", "__MACOSX")
#: Readers by suffix: from path and bytes to sections, as (index, text, ...) dicts.
Reader = Callable[[str, bytes], Iterator[dict]]
_readers: dict[str, Reader] = {}
NATIVE = {".txt": "text", ".text": "text", ".md": "markdown", ".markdown": "markdown", ".vtt": "captions"}
#: Suffixes that are known but need a reader from outside, with what it takes.
OUTSIDE = {".pdf": "sources.pdf", ".pptx": "sources.slides"} | dict.fromkeys(MEDIA_SUFFIXES, "sources.speech with a recognizer")


def register(suffix: str, reader: Reader) -> None:
    """Use `reader` for files of `suffix`. Saying so twice is fine, another reader is an error."""
    key = suffix.lower()
    if not key.startswith("."):
        raise ValueError(f"{suffix!r} must begin with a dot")
    if key in NATIVE or _readers.get(key, reader) is not reader:
        raise ValueError(f"{key} has a reader already")
    _readers[key] = reader


def supported() -> list[str]:
    return sorted({*NATIVE, *_readers})


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def reader_of(path: Column) -> Column:
    """What reads a file: text, markdown or captions, `registered`, or null."""
    suffix = suffix_of(path)
    found = F.when(suffix.isin(*_readers) if _readers else F.lit(False), "registered")
    for own, kind in NATIVE.items():
        found = found.when(suffix == own, kind)
    return found


def route(path: str) -> str:
    """The suffix that decides on a file's reader; an error that lists the known ones if there is none."""
    name = path.rsplit("/", 1)[-1]
    suffix = name[name.rindex(".") :].lower() if "." in name[1:] else ""
    if suffix in NATIVE or suffix in _readers:
        return suffix
    why = f"it needs {OUTSIDE[suffix]}: register a reader" if suffix in OUTSIDE else "it has no reader"
    raise ValueError(f"{path}: {why}. Supported: {', '.join(supported())}")


def root_of(spark: SparkSession, folder: str) -> str:
    """The folder as a URI; an error if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise FileNotFoundError(folder)
    if not system.getFileStatus(path).isDirectory():
        raise NotADirectoryError(folder)
    return system.makeQualified(path).toString().rstrip("/")


def list_tree(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path (relative to `folder`) and length of all files below it; hidden and junk names are left out."""
    root = root_of(spark, folder)

    def entries(batches):
        system, base = arrow_filesystem(root)
        for batch in batches:
            for below in batch["path"]:
                rows = []
                for info in system.get_file_info(fs.FileSelector(f"{base}/{below}".rstrip("/"))):
                    if not info.base_name.startswith(".") and info.base_name not in JUNK:
                        rows.append((f"{below}/{info.base_name}".lstrip("/"), info.size or 0, info.type == fs.FileType.Directory))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "length", "folder"]).astype({"length": "int64"})

    level, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        seen = materialise(level.repartition("path").mapInPandas(entries, "path string, length long, folder boolean"), "listing")
        files = seen.filter("not folder").select("path", "length")
        found = files if found is None else found.unionByName(files)
        level = seen.filter("folder").select("path")
        if not recursive or level.isEmpty():
            return found


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> list[str]:
    """Paths below `folder`, in the order of their parts, for folders that are small enough for a list."""
    return [r["path"] for r in list_tree(spark, folder, recursive).orderBy(F.split("path", "/")).collect()]


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> tuple[DataFrame, int]:
    """Files (path, length) that have a reader, and how many have none."""
    every = list_tree(spark, folder, recursive)
    good = reader_of(F.col("path")).isNotNull()
    return every.filter(good), every.filter(~good).count()


def contents(spark: SparkSession, folder: str, paths: DataFrame) -> DataFrame:
    """path and content of files below `folder`."""
    root = root_of(spark, folder)

    def read(batches):
        system, base = arrow_filesystem(root)
        for batch in batches:
            for path in batch["path"]:
                with system.open_input_file(f"{base}/{path}") as source:
                    yield pd.DataFrame({"path": [path], "content": [source.read()]})

    return paths.select("path").repartition("path").mapInPandas(read, "path string, content binary")


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 if valid, else Latin-1, with `\\n` as the end of lines."""
    utf8 = F.decode(F.when(F.is_valid_utf8(content.cast("string")), content), "UTF-8")
    return T.newlines(F.coalesce(utf8, F.decode(content, "ISO-8859-1")))


def read_documents(spark: SparkSession, folder: str, paths: list[str] | DataFrame) -> DataFrame:
    """path (below `folder`), suffix, title, sections, error of files below `folder`, given as a list or as rows (path).

    Text formats are parsed by column expressions; others by their reader. Files
    of which nothing is left, or that their reader can't read, are rows without
    sections, the latter with the error; a file without a reader is an error.
    """
    rows = paths if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")
    kind = reader_of(F.col("path"))
    unread = rows.filter(kind.isNull()).first()
    if unread:
        route(unread["path"])
    return parsed(contents(spark, folder, rows.filter(kind != "registered")), contents(spark, folder, rows.filter(kind == "registered")))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """As `read_documents`, for all files below `folder` that have a reader, by the data source: many small files share a task."""
    own = datasource.files_of(spark, root_of(spark, folder))
    of = lambda suffixes: own.filter(F.col("suffix").isin(*suffixes)).select("path", "content")
    return parsed(of(NATIVE), of(_readers) if _readers else of(["."]))


def parsed(native: DataFrame, registered: DataFrame) -> DataFrame:
    """Documents of files (path, content): those that expressions parse, and those that have a registered reader."""
    kind = reader_of(F.col("path"))
    suffix = suffix_of(F.col("path")).alias("suffix")
    text = native.select("path", suffix, kind.alias("kind"), decoded(F.col("content")).alias("text"))
    stem = T.humanize(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1))
    is_kind = lambda k: F.col("kind") == k
    own = F.when(is_kind("text"), S.text_sections(F.col("text"))).when(is_kind("markdown"), S.markdown_sections(F.col("text"))).otherwise(S.vtt_sections(F.col("text")))
    title = F.when(is_kind("markdown"), T.markdown_title(F.col("text"), stem)).when(is_kind("text"), T.text_title(F.col("text"), stem)).otherwise(stem)
    out = text.select("path", "suffix", title.alias("title"), own.alias("sections"), F.lit(None).cast("string").alias("error"))
    if not _readers:
        return out
    readers = dict(_readers)
    names = [f.split(": ")[0] for f in SECTION[len("struct<") : -1].split(", ")]

    def run(batches):
        for batch in batches:
            made = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                own_suffix = path[path.rindex(".") :].lower()
                try:
                    found, error = [dict.fromkeys(names) | s for s in readers[own_suffix](path, bytes(content))], None
                except Exception as why:  # a bad file is a row that says so, and the others are read
                    found, error = [], f"{type(why).__name__}: {why}"
                made.append((path, own_suffix, path.rsplit("/", 1)[-1].rsplit(".", 1)[0], found, error))
            if made:
                yield pd.DataFrame(made, columns=["path", "suffix", "title", "sections", "error"])

    return out.unionByName(registered.mapInPandas(run, f"path string, suffix string, title string, sections array<{SECTION}>, error string"))
