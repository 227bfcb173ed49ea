"""Every registered query against its SQL, over whole tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def test_every_query_has_sql():
    from contract.queries import QUERIES

    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    expected = duck.sql(contract.oracle_sql()[name])
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got == canonical(expected.fetchall(), expected.columns)
