"""Every query of the domain against its SQL."""

import os

import duckdb
import pytest

from tilewise.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf_dir, db, name):
    df, rel = catalogue.QUERIES[name](spark, sf_dir), db.sql(catalogue.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    place = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(norm(r[i]) for i in place) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert not catalogue.QUERIES[name](spark, sf_dir).isEmpty()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
