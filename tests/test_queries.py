"""Every query with SQL against DuckDB on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from quire.plans import queries as kb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(columns, rows):
    order = sorted(columns)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in order)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(kb.ORACLE_SQL))
def test_query(spark, con, name):
    df = kb.QUERIES[name](spark, SF)
    found = con.execute(kb.ORACLE_SQL[name])
    columns = {d[0]: str(d[1]) for d in found.description}
    want = [dict(zip(columns, r)) for r in found.fetchall()]
    assert {c: TYPES[t] for c, t in df.dtypes} == columns
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "score"]
    assert set(kb.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_llm():
    """Without the operators' folders, or what they need, the entry gives the engine's queries."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r} or name.startswith({gone!r} + "."):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from quire.plans import queries as kb
assert set(e.queries()) == set(kb.QUERIES) and set(e.oracle_sql()) == set(kb.ORACLE_SQL)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for gone in ("quire.llm", "corpus_pipeline", "xxhash"):
        subprocess.run([sys.executable, "-c", code.format(gone=gone)], cwd=root, check=True)


ODD = [None, "", " ", "\n", "a\n\nb", "\n\nc", "x \U0001f600 y", "\U0001f600" * 7, "a" * 199 + "\U0001f600", "STRAßE DER", "Größe\nMaße ŉ", "﻿mark", "no break　", " x ", "a b \u0085", "bell\x07 \x0c \x0b", "\x0b", "_x0007_ _x005F_x0007_ _x0041_", "c\r\nd\te ", "&lt;b&gt; <i>"]


@pytest.mark.parametrize("name", ["extracted_files", "heading_detect", "token_estimates"])
def test_odd_texts(spark, tmp_path, name):
    """Null, empty and blank texts, empty lines, and characters beyond the tables' give what SQL gives."""
    d = spark.createDataFrame([(k * len(ODD) * 8 + i * 8 + k, t) for k in range(8) for i, t in enumerate(ODD)], "doc_id long, text string")
    d.selectExpr("*", "'en' lang", "'src0' source", "cast(coalesce(length(text), 0) as long) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = kb.QUERIES[name](spark, str(tmp_path))
    found = c.execute(kb.ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, [dict(zip(columns, r)) for r in found.fetchall()])
