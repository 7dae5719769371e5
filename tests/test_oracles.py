"""Each query with SQL returns what DuckDB returns."""

import math
import os

import duckdb
import pytest

from skeinflow.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return int(value) if isinstance(value, bool) else value


def same(ours, theirs):
    def rows(columns, data):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)

    assert rows(*ours) == rows(*theirs)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    frame = QUERIES[name](spark, SF)
    found = [tuple(r) for r in frame.collect()]
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        same((frame.columns, found), ([d[0] for d in result.description], result.fetchall()))
