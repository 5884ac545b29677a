"""Every registered query against the same query in SQL on a second engine."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

from grovekeep.plans.catalog import QUERIES as CATALOG

QUERIES = {name: build for name, build in entry_points.queries().items() if name in CATALOG}
SQL = {name: sql for name, sql in entry_points.oracle_sql().items() if name in CATALOG}
TYPES = {"int64": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "bool": "BOOLEAN"}


@pytest.fixture(scope="module")
def engine(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(names, rows):
    index = [names.index(c) for c in sorted(names)]
    return sorted(tuple(repr(row[i]) for i in index) for row in rows)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, engine, sf, name):
    ours = QUERIES[name](spark, sf).toArrow()
    cursor = engine.execute(SQL[name])
    names, kinds = [c[0] for c in cursor.description], {c[0]: str(c[1]) for c in cursor.description}
    assert sorted(ours.column_names) == sorted(names)
    assert {c: TYPES[str(ours.schema.field(c).type)] for c in ours.column_names} == kinds
    rows = list(zip(*[ours.column(c).to_pylist() for c in ours.column_names]))
    assert ordered(ours.column_names, rows) == ordered(names, cursor.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
