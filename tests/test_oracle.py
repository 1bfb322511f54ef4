"""Every query against its SQL counterpart on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as contract
from hearthline.plans import catalog

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def canonical(rows):
    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(v) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in row) for row in rows)


def test_every_query_has_sql():
    assert set(catalog.BUILDERS) <= set(contract.queries())
    assert set(catalog.BUILDERS) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.BUILDERS))
def test_query_equals_sql(spark, engine, name):
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = [tuple(row[c] for c in columns) for row in df.collect()]
    cursor = engine.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    assert canonical(found) == canonical(expected)
