"""Every query with a SQL twin gives the twin's rows on the small tables."""

import glob
import math
import os

import pytest
from conftest import SMALL

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(rows):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(v) for v in row) for row in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    frame = QUERIES[name](spark, SMALL)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    assert sorted(frame.columns) == sorted(names)
    for field in frame.schema:
        assert KINDS[field.dataType.simpleString()] == kinds[field.name], field.name
    expected = canon(cursor.fetchall())
    assert canon(frame.select(*[f"`{n}`" for n in names]).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert len(QUERIES[name](spark, SMALL).take(1)) >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_twins_have_queries():
    assert set(ORACLES) <= set(QUERIES)
