"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from terrace.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = [tuple(_plain(r[c]) for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    found = duck.execute(catalog.ORACLE_SQL[name])
    names, kinds = [d[0] for d in found.description], {d[0]: str(d[1]) for d in found.description}
    theirs = [tuple(_plain(row[names.index(c)]) for c in columns) for row in found.fetchall()]
    assert sorted(names) == columns
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
