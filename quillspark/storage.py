"""Intermediate tables in the folder that the whole cluster shares.

A DataFrame that is read more than once, or that an iterative algorithm
rebuilds, is written once as Parquet and read back. Lineage ends at those
files, so a lost executor costs a re-read and not a recomputation, and no
executor's own disk holds the only copy.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_local: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one in local mode only."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get(KEY, None) or conf.get(KEY, None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master") != "local":
        raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="quillspark-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def clear(spark: SparkSession) -> None:
    """Remove all that this process has put into the shared folder; results that read it end here."""
    while _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def arrow_uri(uri: str) -> str:
    """A path as Hadoop names it, as Arrow's file systems name it."""
    return re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri))


def arrow_filesystem(uri: str):
    """(file system, path in it) of a path that executors read or write without Spark."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


def materialise(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write `df` once to the shared folder and return the table as read back.

    `files` bounds the number of files of a table that is small beside the corpus.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _marker(spark: SparkSession, path: str, run: str = ""):
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_runs/{run}" if run else f"{path}/_runs")
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


class Run:
    """Tables that are appended together: none of them counts before the marker of the run is there.

    A run that fails between two tables leaves files that nobody reads; run again
    under its id it writes them anew, and one that has been committed is left as it is.
    """

    def __init__(self, spark: SparkSession, path: str, run: str) -> None:
        self.spark, self.path, self.run = spark, path.rstrip("/"), run

    @property
    def done(self) -> bool:
        at, system = _marker(self.spark, self.path, self.run)
        return system.exists(at)

    def write(self, table: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/run={self.run}")

    def commit(self) -> None:
        """Creating the marker either succeeds or fails, so the run's tables appear at once."""
        at, system = _marker(self.spark, self.path, self.run)
        system.create(at, False).close()

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}/run={self.run}")


def committed_runs(spark: SparkSession, path: str) -> list[str]:
    """Ids of the runs below `path` whose marker is there."""
    at, system = _marker(spark, path.rstrip("/"))
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def committed(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of all committed runs; of runs that have more columns than `schema`, those in it."""
    paths = [f"{path.rstrip('/')}/{table}/run={run}" for run in committed_runs(spark, path)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
