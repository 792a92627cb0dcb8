"""The driver's contract, without running every query."""

import importlib

import duckdb


def test_names():
    entry = importlib.import_module("__spark_entry__")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 35
    for name, f in queries.items():
        assert callable(f), name


def test_flagship_against_sql(spark):
    entry = importlib.import_module("__spark_entry__")
    got = {tuple(r) for r in entry.entry(spark).select("entity", "n_values", "facts").collect()}
    c = duckdb.connect()
    c.sql("CREATE VIEW lineitem AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'")
    want = set(c.sql(f"SELECT entity, n_values, facts FROM ({entry.oracle_sql()['contradictions']})").fetchall())
    assert got == want and got
