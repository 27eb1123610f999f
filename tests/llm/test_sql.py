"""Operators that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from quire.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted((tuple(dict(zip(columns, r))[c] for c in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_runs_over_the_whole_table(spark, name):
    n = queries.QUERIES[name](spark, SF).count()
    table = {"op4": "conversations", "op7": "pages"}.get(name.split("_")[0], "documents")
    assert n > 0 if name in ("op4_chats", "op12_spelling_variants") else n == spark.read.parquet(f"{SF}/{table}.parquet").count()
