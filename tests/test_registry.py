"""Every registered query against its SQL twin on the given tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as spark_entry

DATA = Path("/root/testdata/sf0.01")
TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()

QUERIES, TWINS = spark_entry.queries(), spark_entry.oracle_sql()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, Decimal):
        return float(value)
    return round(value, 9) if isinstance(value, float) else value


def test_every_query_has_a_twin():
    from cellward.plans import registry

    assert set(registry.load()[0]) == set(registry.load()[1]) <= set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    result = QUERIES[name](spark, str(DATA))
    columns = sorted(result.columns)
    got = [tuple(comparable(row[c]) for c in columns) for row in result.collect()]
    relation = duck.execute(TWINS[name])
    theirs = [d[0] for d in relation.description]
    assert sorted(theirs) == columns
    places = [theirs.index(c) for c in columns]
    want = [tuple(comparable(row[i]) for i in places) for row in relation.fetchall()]
    assert got, "an empty result proves nothing"
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    rows = spark_entry.entry(spark).collect()
    assert rows and min(r["Count_Patients"] for r in rows) >= 20
