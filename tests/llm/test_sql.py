"""Every query of this folder that SQL can express, against its SQL."""

import duckdb
import pytest

from innsight.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == expected
    assert expected


def test_queries_without_sql():
    """Trained models, tokenizers, a keyed network and a hash that SQL lacks."""
    assert {name.split("_")[0] for name in QUERIES.keys() - ORACLE.keys()} == {
        "op1", "op2", "op3", "op5", "op7", "op8", "op11",
    }
