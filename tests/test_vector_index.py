"""The vector index: its exact search against brute force, its probed one by recall, and how much both read."""

import os
import re

import numpy as np
import pytest

from quire.operators import search, vector_index
from quire.operators.vector_index import Model, VectorIndex
from quire.sources import shared

SF = "/root/testdata/sf0.1"


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>").repartition(parts)


def rows(df):
    return sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect())


def clustered(n=6000, dims=32, centres=60):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(centres, dims))
    return (c[rng.integers(0, centres, n)] + 0.25 * rng.normal(size=(n, dims))).astype(np.float32)


def test_exact_search(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 10)).round(2)
    x[7] = 0
    x[20:25] = x[19]
    v = frame(spark, x)
    odd = spark.createDataFrame([(900, None), (901, [1.0, 2.0]), (902, [None] + [1.0] * 9), (903, [2.0, 4.0])], v.schema)
    v = v.unionByName(odd).unionByName(v.filter("id = 30"))
    q = v.filter("id % 25 = 19 OR id > 890").withColumnRenamed("id", "query_id").dropDuplicates(["query_id"])
    index = VectorIndex.build(v, cells=12, bytes_=5)
    for k, threshold in ((5, 0.3), (3, 0.9), (600, -1.0)):
        assert rows(index.search(q, k, threshold)) == rows(search.top_k_batch(v, q, k, threshold))
    assert index.search(q.limit(0)).count() == 0


@pytest.mark.parametrize("data", [[], [(1, None), (2, [0.0, 0.0])], [(1, [1.0, 0.0])]])
def test_small_tables(spark, data):
    v = spark.createDataFrame(data, "id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, embedding array<double>")
    assert rows(VectorIndex.build(v).search(q, 5, 0.5)) == rows(search.top_k_batch(v, q, 5, 0.5))


def scanned(df, cells=None):
    """Bytes of a table's files, or of those of some cells, which are folders."""
    of = [f.removeprefix("file://").removeprefix("file:") for f in df.inputFiles()]
    return sum(os.path.getsize(f) for f in of if cells is None or int(re.search("cell=([0-9]+)", f)[1]) in cells)


def test_clustered_vectors_are_found_by_reading_little(spark):
    x = clustered()
    v = frame(spark, x, 2)
    index = VectorIndex.build(v, cells=60, bytes_=8)
    q = v.filter("id % 600 = 0").withColumnRenamed("id", "query_id")
    want = rows(search.top_k_batch(v, q, 5, 0.5))
    assert rows(index.search(q, 5, 0.5)) == want
    probes, keep = index.tuned(0.95)
    got = rows(index.search(q, 5, 0.5, probes=probes, keep=keep))
    assert len({r[:2] for r in got} & {r[:2] for r in want}) >= 0.9 * len(want) and probes <= 4
    one = q.filter("query_id = 600")
    cells = index._cells(one, 0.5, probes)
    read = sum(scanned(spark.read.parquet(f"{index.path}/{kind}"), cells) for kind in ("codes", "vectors"))
    assert read < 0.2 * scanned(spark.read.parquet(f"{index.path}/vectors"))


def test_recall_over_the_given_vectors(spark):
    """These have no clusters: probes are tuned to nearly all cells, and what is saved is that codes are read instead of vectors."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    q = v.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    index = VectorIndex.build(v)
    want = {r[:2] for r in rows(search.top_k_batch(v, q, 5, 0.2))}
    probes, keep = index.tuned(0.95)
    assert len({r[:2] for r in rows(index.search(q, 5, 0.2, probes=probes, keep=keep))} & want) >= 0.9 * len(want)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = Model.fitted(x[:200], 9, 4)
    cell, codes, error, angle = m.encoded(x)
    m.widest = np.array([max([-1.0, *angle[cell == c]]) for c in range(len(m.centroids))])
    s = x @ x.T
    assert (np.abs(s - x @ m.decoded(cell, codes).T) <= error + 1e-9).all()
    assert (s <= m.most(x)[:, cell] + 1e-9).all()


def test_bounds_leave_few_vectors_open(spark):
    """Without clusters too: what has to be compared exactly is a few vectors a query, not most."""
    rng = np.random.default_rng(4)
    v = frame(spark, rng.normal(size=(3000, 64)).astype(np.float32))
    q = v.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    index = VectorIndex.build(v)
    taken, written = [], shared.written
    with pytest.MonkeyPatch.context() as m:
        m.setattr(shared, "written", lambda df, name, rows=None: taken.append((name, out := written(df, name, rows))) or out)
        assert rows(index.search(q, 5, 0.2)) == rows(search.top_k_batch(v, q, 5, 0.2))
    n = {name: df.count() for name, df in taken}
    assert n["index-bounds"] < 30 * 60 and n["index-candidates"] < 30 * 12


def test_groups_give_the_same_hits(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = frame(spark, rng.normal(size=(300, 8)))
    q = v.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    index = VectorIndex.build(v, cells=7, bytes_=3)
    monkeypatch.setattr(vector_index, "GROUP_NUMBERS", 8 * 13)
    assert rows(index.search(q, 5, 0.1)) == rows(search.top_k_batch(v, q, 5, 0.1))
