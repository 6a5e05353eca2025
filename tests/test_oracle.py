"""Every query with SQL, on the smallest tables, value by value against DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return (0, str(v))
    v = float(v)
    return (1, math.copysign(1, v) if v == 0 else v)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
    # Queries of the training package have tests of their own, against brute force where there is no SQL.
    added = set() if contract.training is None else {*contract.training.queries(), "pipeline"}
    assert set(QUERIES) - added - set(SQL) == {
        "gbt_forecast", "tree_forecast", "engine_gbt_eval", "gbt_split_importance", "feature_elimination"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    want = duck.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({SQL[name]})").fetchall()
    assert got == sorted(tuple(plain(v) for v in r) for r in want)
