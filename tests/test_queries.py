"""Every core query that SQL can express, against DuckDB on the smallest corpus."""

import os

import pytest

from quarrymap.plans import project_queries, queries  # noqa: F401  adds its queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(map(tuple, frame[names].astype(str).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no corpus")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, DIR).toPandas()) == rows(duck.execute(queries.SQL[name]).df())
