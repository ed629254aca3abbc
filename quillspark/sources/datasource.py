"""Files below a folder as a Spark data source: `spark.read.format("quillspark_files").load(folder)`.

Rows are path (below the folder), suffix, length and content. Files are put
together into tasks of bounded bytes, so that many small ones share a task and a
large one has its own; a filter on `suffix` leaves the others unread, and with the
option `content=false` nothing is opened. `register(spark)` makes it known.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quillspark.storage import arrow_filesystem

FORMAT = "quillspark_files"
#: Bytes and files of a task, unless the options `taskBytes` and `taskFiles` say otherwise; a batch ends at this many bytes.
TASK_BYTES, TASK_FILES, BATCH_BYTES = 64 << 20, 5_000, 8 << 20
JUNK = ("__MACOSX", "Thumbs.db", ".DS_Store")
SCHEMA = pa.schema([("path", pa.string()), ("suffix", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


def suffix_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name[name.rindex(".") :].lower() if "." in name[1:] else ""


class Files(InputPartition):
    """What one task reads: (path, length)."""

    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(None)
        self.files = files


class FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].rstrip("/")
        self.recursive = options.get("recursive", "true") == "true"
        self.opened = options.get("content", "true") == "true"
        self.bytes, self.count = int(options.get("taskbytes", TASK_BYTES)), int(options.get("taskfiles", TASK_FILES))
        self.suffixes: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what says which suffixes are wanted; Spark looks after the rest."""
        for own in filters:
            wanted = {own.value} if isinstance(own, EqualTo) else set(own.value) if isinstance(own, In) else None
            if wanted is None or own.attribute != ("suffix",):
                yield own
            else:
                self.suffixes = wanted if self.suffixes is None else self.suffixes & wanted

    def listed(self) -> list[tuple[str, int]]:
        """Names and lengths, which the driver holds; contents are read by tasks alone."""
        system, base = arrow_filesystem(self.folder)
        found = []
        for info in system.get_file_info(fs.FileSelector(base, recursive=self.recursive)):
            path = info.path[len(base) :].lstrip("/")
            hidden = any(part.startswith(".") or part in JUNK for part in path.split("/"))
            if info.type == fs.FileType.File and not hidden and (self.suffixes is None or suffix_of(path) in self.suffixes):
                found.append((path, info.size or 0))
        return sorted(found, key=lambda f: f[0].split("/"))

    def partitions(self) -> list[InputPartition]:
        tasks: list[InputPartition] = []
        held: list[tuple[str, int]] = []
        size = 0
        for path, length in self.listed():
            if held and (size + length > self.bytes or len(held) >= self.count):
                tasks.append(Files(held))
                held, size = [], 0
            held.append((path, length))
            size += length
        return [*tasks, Files(held)] if held or not tasks else tasks

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, base = arrow_filesystem(self.folder)
        rows, size = [], 0
        for path, length in partition.files:
            content = None
            if self.opened:
                with system.open_input_file(f"{base}/{path}") as source:
                    content = source.read()
                size += len(content)
            rows.append({"path": path, "suffix": suffix_of(path), "length": length, "content": content})
            if size >= BATCH_BYTES or len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


class FileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, suffix string, length long, content binary"

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known; filters are pushed into Python sources only if the session says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileSource)


def files_of(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """Files below a folder, of the suffixes alone if some are given."""
    register(spark)
    rows = spark.read.format(FORMAT).load(folder)
    return rows if suffixes is None else rows.filter(rows["suffix"].isin(*suffixes))
