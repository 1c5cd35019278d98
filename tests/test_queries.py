"""Queries that SQL can express, against DuckDB; the others by their properties."""

import duckdb
import pytest

import __spark_entry__ as contract
from strideframe.plans import queries as q
from strideframe.plans.registry import oracle_sql, queries

ORACLES = oracle_sql()

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def by_value(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)) if x is None else "", 0 if x is None else x) for x in r])


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, con, name):
    df = queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = by_value(tuple(r) for r in df.select(*cols).collect())
    spark.catalog.clearCache()
    assert got
    assert got == by_value(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_bones_are_fitted(spark, sf):
    before = {(r["clip_key"], r["bone"]): r["std_m"] for r in q.bone_lengths(spark, sf).collect()}
    after = {(r["clip_key"], r["bone"]): r["std_m"] for r in q.pbd_fit_skeleton(spark, sf).collect()}
    assert before.keys() == after.keys()
    assert sum(v or 0 for v in after.values()) < sum(v or 0 for v in before.values())
