"""What queries must not do: move texts by a key, or scan more than they need."""

import pytest

from quire.plans import queries as kb
from quire.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["chunk_listing", "chunk_by_index", "chunk_texts_ordered", "chunk_lookup", "chunk_stats", "documents_completed_by_user"])
def test_texts_stay_where_they_are_read(spark, name):
    p = plan(kb.QUERIES[name](spark, SF))
    assert "hashpartitioning" not in p and "Window" not in p


def test_contents_move_only_texts_of_hits(spark):
    """Ids that are few are sent to the documents, in each of which the scan is below a semi join with them."""
    ids = spark.range(0, 40, 7).select("id")
    p = plan(tables.contents(spark, SF, ids))
    assert p.count("LeftSemi") >= 2 and "SortMergeJoin LeftSemi" not in p and "ShuffledHashJoin LeftSemi" not in p
    assert sorted(r["id"] for r in tables.contents(spark, SF, ids).collect()) == [0, 7, 14, 21, 28, 35]


def test_the_guard_looks_at_few_documents(spark):
    assert "GlobalLimit" in plan(tables.any_completed(spark, SF)) or "CollectLimit" in plan(tables.any_completed(spark, SF))
    assert tables.any_completed(spark, SF).count() == 1 and tables.any_completed(spark, SF, first=0).count() == 1
