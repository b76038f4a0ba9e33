"""Every registered query against its SQL in DuckDB on the smallest test tables."""

import inspect
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from ferrytrace.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def _plain(value):
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry_point.queries())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["key", "value", "bytes"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(row[c]) for c in columns) for row in df.collect())
    result = duck.execute(entry_point.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert {f.name: DUCK_TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    want = sorted(tuple(_plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert got == want
    assert got, "a query that returns nothing checks nothing"


def test_no_python_on_the_data_path():
    """No UDFs, RDD code, unsafe checkpoints or broadcast hints anywhere in the delivery library."""
    root = Path(inspect.getfile(entry_point)).parent / "ferrytrace"
    files = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    text = "\n".join(p.read_text() for p in files)
    for banned in ("udf(", ".rdd", "localCheckpoint", "crossJoin", "broadcast(", "toPandas", ".collect()"):
        assert banned not in text, banned
