"""Every registered query against its SQL on the smallest tables."""

import datetime
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from recordloom.plans import all_queries, oracles  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else value


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query(spark, tables, name):
    frame = all_queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(plain(row[c]) for c in columns)) for row in frame.collect())
    result = tables.execute(oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in result.fetchall())
    assert got == want


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(oracles())
