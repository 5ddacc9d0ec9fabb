import importlib.util
import os
import random

import duckdb
import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
FOLDER = "/root/testdata/sf0.001"

WORDS = "the of and to in is was red blue green tea tree sun moon star rain snow wind fire".split()


@pytest.fixture(scope="session")
def contract():
    spec = importlib.util.spec_from_file_location("spark_entry_llm", f"{ROOT}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text) of the smallest test table."""
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'")
    return rows.fetchall()


@pytest.fixture
def frame(spark):
    """Makes a documents frame, with more columns of whatever names."""

    def make(rows, clash=()):
        schema = T.StructType(
            [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
            + [T.StructField(name, T.StringType()) for name in clash]
        )
        return spark.createDataFrame([(*row, *("x" for _ in clash)) for row in rows], schema)

    return make


@pytest.fixture(scope="session")
def prose():
    """Makes texts of common words."""
    draw = random.Random(7)
    return lambda n: " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture
def awkward(prose):
    """Rows that every operator must take: nulls, empty and very long texts, repeats."""
    long = prose(20_000)
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, long),
        (4, long),
        (5, "a" * 30_000),
        (None, "no id here"),
        (None, None),
        (6, prose(30)),
        (6, prose(30)),
    ]
