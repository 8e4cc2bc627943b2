"""Every query with SQL gives the rows of DuckDB, on the smallest tables; the others run."""

import math

import duckdb
import numpy as np
import pytest

from quarry.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in value)
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    out = duck.execute(SQL[name])
    theirs = [d[0] for d in out.description]
    assert sorted(theirs) == columns
    expected = sorted((tuple(plain(r[theirs.index(c)]) for c in columns) for r in out.fetchall()), key=repr)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
