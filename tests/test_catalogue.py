"""Every query of the catalogue against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunking
from quillspark.plans import catalogue
from quillspark.session import table
from quillspark.sources.sections import line_sections

FOLDER = os.environ.get("CATALOGUE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def cell(value) -> str:
    if value is None or value is pd.NA or value != value:
        return "null"
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(map(tuple, df[sorted(df.columns)].map(cell).itertuples(index=False)))


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


def test_words_in_are_words_out(spark):
    """Nothing of a text is left out on the way into the queries that merge and chunk it."""
    words = lambda df, column: df.agg(F.sum(T.word_count(F.col(column)))).first()[0]
    docs = table(spark, FOLDER, "documents")
    every = words(docs, "text")
    assert words(catalogue.timed(spark, FOLDER).select(F.explode("sections").alias("s")).select("s.text"), "text") == every
    whole = chunking.chunk_documents(docs.select("doc_id", line_sections(F.col("text")).alias("sections")), config=chunking.ChunkConfig(450, 700, 0, 0))
    assert words(whole, "text") == every
    said = words(table(spark, FOLDER, "conversations").filter("text is not null"), "text")
    assert words(catalogue.turns(spark, FOLDER), "text") == said


def test_every_query_has_its_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
