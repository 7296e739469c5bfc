"""Every registered query against its independent DuckDB SQL (sf0.001)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_registered_with_oracle_or_rows_only():
    assert set(ORACLES) <= set(QUERIES)
    from stackwise.plans.catalog import QUERIES as own

    assert set(own) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = _canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLES[name])
    want = _canon([d[0] for d in res.description], res.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", ["pca_project", "dbn_end_to_end"])
def test_rows_only_queries_run(spark, name):
    rows = QUERIES[name](spark, SF_SMALL).collect()
    assert len(rows) > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) == {"loss", "hit_rate", "n"}


@pytest.mark.parametrize("sf", [SF_SMALL, "/root/testdata/sf0.01"])
def test_flagship_matches_unrolled_sql(spark, sf):
    """H3 end to end (prepare, mini-batch pretraining of both layers, fine-tuning, scoring)
    against its SQL unrolling, at both small scale factors, on DuckDB's default settings."""
    from oracles.end_to_end import dbn_end_to_end_sql

    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{sf}/orders.parquet')")
    res = c.execute(dbn_end_to_end_sql())
    want = _canon([d[0] for d in res.description], res.fetchall())
    df = QUERIES["dbn_end_to_end"](spark, sf)
    got = _canon(df.columns, [tuple(r) for r in df.collect()])
    assert got == want
