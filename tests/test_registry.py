"""Every registered query against its SQL, on the smallest test tables."""

import importlib.util
import os

import duckdb
import pytest

from innsight.registry.oracle import ORACLE
from innsight.registry.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

spec = importlib.util.spec_from_file_location("spark_entry", f"{ROOT}/__spark_entry__.py")
contract = importlib.util.module_from_spec(spec)
spec.loader.exec_module(contract)

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}
WITHOUT_SQL = {"model_metrics", "model_metrics_by_city", "price_adjustment"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_only_the_model_has_no_sql():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert QUERIES.keys() <= contract.queries().keys()
    assert ORACLE.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    kinds = dict(zip(columns, (str(c[1]) for c in result.description)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    expected = sorted((repr(row) for row in result.fetchall()))
    actual = sorted((repr(tuple(row)) for row in df.select(*columns).collect()))
    assert actual == expected
    assert actual, "a query without rows checks nothing"


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_model_queries(spark, name):
    rows = contract.queries()[name](spark, FOLDER).collect()
    assert rows
    for row in rows:
        values = row.asDict()
        assert values["records"] > 0
        if "r2" in values:
            assert values["r2"] > 0.9 and values["rmse"] < 0.1
        else:
            assert abs(values["adjustment_pct"]) < 5


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 10 and df.columns[0] == "hotel_id"


def test_no_cartesian_product_and_no_python_in_plans(spark):
    for name, query in QUERIES.items():
        if name.startswith(("model", "price_adjustment", "stream")):
            continue
        plan = query(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
            assert operator not in plan, (name, operator)
