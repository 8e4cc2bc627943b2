"""Operators that SQL can express give DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from quarry.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = connection.execute(SQL[name])
    columns = sorted(d[0] for d in out.description)
    place = [[d[0] for d in out.description].index(c) for c in columns]
    frame = QUERIES[name](spark, sf_dir)
    assert sorted(frame.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == sorted((tuple(r[i] for i in place) for r in out.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_return_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
