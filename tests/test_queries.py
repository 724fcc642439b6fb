"""Every registered query against its SQL, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    got = entry.queries()[name](spark, data)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = Counter(tuple(plain(v) for v in row) for row in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["state", "next_state", "n", "p"]


def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
