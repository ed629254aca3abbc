"""Files as a data source, against the reader that lists on executors."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources import datasource, files


@pytest.fixture
def folder(tmp_path):
    for i in range(60):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"n{i}.{['txt', 'MD', 'vtt', 'bin'][i % 4]}").write_text(f"# Title {i}\n\n" + f"word{i} " * 30 if i % 4 < 2 else f"WEBVTT\n\n00:01.000 --> 00:02.000\ncue {i}\n")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "d1" / "__MACOSX").mkdir()
    (tmp_path / "d1" / "__MACOSX" / "a.txt").write_text("no")
    (tmp_path / "large.txt").write_text("large " * 20000)
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "noext").write_text("x")
    return f"file://{tmp_path}"


def test_same_documents_as_by_listing(spark, folder):
    paths, _ = files.scan(spark, folder)
    rows = lambda df: sorted((r["path"], r["suffix"], r["title"], str(r["sections"]), r["error"]) for r in df.collect())
    got = rows(files.read_folder(spark, folder))
    assert got == rows(files.read_documents(spark, folder, paths)) and len(got) == 47


def test_many_small_files_share_a_task_and_a_large_one_has_its_own(spark, folder):
    datasource.register(spark)
    rows = spark.read.format(datasource.FORMAT).option("taskBytes", 50_000).option("taskFiles", 25).load(folder)
    held = {}
    for r in rows.select("path", F.spark_partition_id().alias("task"), "length", F.octet_length("content").alias("n")).collect():
        assert r["length"] == r["n"]
        held.setdefault(r["task"], []).append(r["path"])
    assert sorted(map(len, held.values()))[0] >= 1 and max(map(len, held.values())) <= 25 and len(held) < 8
    assert len(next(own for own in held.values() if "large.txt" in own)) < 25
    assert sum(map(len, held.values())) == 63


def test_a_filter_on_suffixes_leaves_files_unread(spark, folder):
    where = folder.removeprefix("file://")
    os.chmod(f"{where}/large.txt", 0)  # reading it would fail, unless as root
    os.rename(f"{where}/d0", f"{where}/d9")
    reader = datasource.FileReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    other = GreaterThan(("length",), 5)
    assert list(reader.pushFilters([In(("suffix",), (".md", ".vtt")), other, EqualTo(("suffix",), ".md")])) == [other]
    assert {datasource.suffix_of(p) for p, _ in reader.listed()} == {".md"}
    got = datasource.files_of(spark, folder, [".md"])
    assert got.count() == 15 and "large.txt" not in {r["path"] for r in got.collect()}
    names = spark.read.format(datasource.FORMAT).option("content", "false").load(folder)
    assert names.filter("content is not null").count() == 0 and names.count() == 63


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert datasource.files_of(spark, f"file://{tmp_path}").count() == 0
