import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from quire.llm import components, jaccard_join, shingles

rng = random.Random(11)
SCHEMA = "doc_id long, text string, component_id string"


def family(n, size, change, vocabulary=400):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(change + 1)):
            w[rng.randrange(size)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus():
    passage = " ".join(f"p{i}" for i in range(60))
    texts = family(40, 120, 8) + family(10, 40, 3) + family(6, 300, 20) + family(8, 12, 1) + family(5, 5, 1)
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(20)]
    texts += [texts[0], texts[0].upper(), texts[0].replace(" ", "\n\t"), "", None, "one", "one", "One two", " \n", "a b c d", "a b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80), (1, 50)])
def test_against_all_pairs(spark, n, num):
    rows = corpus()
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(4)
    want = brute.components(rows, n, num)
    got = {r["doc_id"]: r for r in jaccard_join.report(d, n=n, num=num).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(brute.shingles(t, n)) for i, t in rows)


def test_blocks(spark, monkeypatch):
    """Groups too large for a task are cut, and no link is lost."""
    rows = corpus()
    monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", 600)
    got = jaccard_join.report(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute.components(rows)


def test_common_shingles_connect_nothing(spark):
    """Pairs of near copies stay groups of their own, however many passages that are found everywhere each of them holds."""
    passages = [" ".join(f"p{k}_{i}" for i in range(12)) for k in range(8)]
    rows = []
    for pair in range(60):
        own = [f"o{pair}_{i}" for i in range(60)]
        for last in ("x", "y"):
            rows.append((len(rows), " ".join([*own, last, *passages])))
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(4)
    tasks = jaccard_join._grouped(d, 4, 85, "doc_id", "text")
    sizes = [r["count"] for r in tasks[2].groupBy("comp").count().collect()]
    assert sizes == [2] * 60
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.report(d).collect()} == brute.components(rows)


def test_nothing_broadcast(spark, monkeypatch):
    """Beyond a bound, sets that can link go through no broadcast, and few other texts are moved for their join."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    rows = corpus() + [(1000 + i, f"alone{i} " * 30) for i in range(500)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = jaccard_join.classes(d, 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute.components(rows)
    active = spark.createDataFrame([(i,) for i in range(100)] + [(None,)], "_k long")
    left = jaccard_join._sieved(d.selectExpr("doc_id AS _dk", "text AS _text"), active).collect()
    assert {r["_dk"] for r in left} >= set(range(100)) and len(left) < 110
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 10**6)
    monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", 600)
    tasks = jaccard_join._grouped(d, 4, 85, "doc_id", "text")
    assert tasks[3] and "Broadcast" not in tasks[2]._jdf.queryExecution().executedPlan().toString()


def test_edge_rows(spark):
    t = "the same words in a row here"
    rows = [(None, t), (7, t), (7, t), (7, "quite another text with other words"), (9, t + " x"), (None, None), (3, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.report(d, n=2, num=80).collect()), key=repr)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (7, 7), (9, 7), (None, None), (3, 3)], key=repr)
    kept = sorted(map(tuple, jaccard_join.deduplicate(d, n=2, num=80).collect()), key=repr)
    assert (3, "") in kept and (None, None) in kept and (9, t + " x") not in kept and (None, t) not in kept and sum(k[0] == 7 for k in kept) == 1
    assert jaccard_join.report(d.limit(0)).count() == 0 and jaccard_join.deduplicate(d.limit(0)).count() == 0


def test_deduplicate(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    c = brute.components(rows, 5, 80)
    kept = jaccard_join.deduplicate(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t in rows if c[i] == i)


def test_tree_compares_few(spark):
    """Of a group of near copies about one pair of lowest nodes a node meets; unlike sets don't meet at all."""
    sets = list(shingles.sets(pa.array(family(1600, 200, 3)), 4))
    tree = jaccard_join.Tree(sets, 85)
    assert len(set(tree.links())) == 1 and tree.met < 300  # of 5,050
    unlike = jaccard_join.Tree(list(shingles.sets(pa.array([" ".join(f"{i} {k}" for k in range(100)) for i in range(1600)]), 4)), 85)
    assert len(set(unlike.links())) == 1600 and unlike.met == 0


def test_sizes_far_apart(spark):
    """Bitmaps don't grow with the largest set, and links between sets larger than they are found."""
    base = [f"w{i}" for i in range(60_000)]
    texts = [" ".join(base), " ".join(base[:-2000]), " ".join(base[:-20_000])] + [f"short text number {i} of many" for i in range(500)]
    tree = jaccard_join.Tree(list(shingles.sets(pa.array(texts), 4)), 85)
    assert tree.levels[0][0].shape[1] <= 2 and tree.links()[:3] in ([0, 0, 2], [1, 1, 2])


def test_clashing_names(spark):
    t = "the same words in a row here"
    d = spark.createDataFrame([(1, t, 1, 2, 3, 4, 5), (2, t, 6, 7, 8, 9, 10), (1, t, 1, 2, 3, 4, 5), (3, None, 1, 1, 1, 1, 1)], "doc_id long, text string, rows int, _k int, _once int, k int, r int")
    got = sorted(map(tuple, jaccard_join.deduplicate(d, 2, 80).collect()))
    assert got == [(1, t, 1, 2, 3, 4, 5), (3, None, 1, 1, 1, 1, 1)]


def test_words_cross_no_text_or_piece(monkeypatch):
    monkeypatch.setattr(shingles, "CHUNK", 16)
    texts = ["ab", "cd ef", None, "", "  x  y", "é" * 40 + " z", "A B c D", "a b C d e\x0bf"]
    got = [len(s) for s in shingles.sets(pa.array(texts).slice(1), 2)]
    assert got == [len(brute.shingles(t, 2)) for t in texts[1:]]
    a, b = shingles.sets(pa.array(["q w E r", "Q W e R"]), 3)
    assert np.array_equal(a, b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (300, 300), (400, 401), (402, 401)] + [(1000, i) for i in range(1001, 1100)]
    d = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(d).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[200] == 100 and got[402] == 400 and all(got[i] == 1000 for i in range(1000, 1100)) and 300 not in got
    assert components.components(d.limit(0)).count() == 0


@pytest.mark.parametrize("task", [8_000_000, 600])
@pytest.mark.parametrize("n,num", [(4, 85), (1, 50)])
def test_every_link_counts(spark, monkeypatch, n, num, task):
    """Also those between sets that others connect already; in groups cut into blocks each once."""
    monkeypatch.setattr(jaccard_join, "TASK_SHINGLES", task)
    rows = list(enumerate([t for _, t in corpus()] + family(30, 120, 2)))
    first, members = {}, {}
    for i, t in rows:
        if s := frozenset(brute.shingles(t, n)):
            first.setdefault(s, i)
            members.setdefault(s, []).append(i)
    own = list(first)
    want = {(first[x], first[y]): len(x & y) for k, x in enumerate(own) for y in own[k + 1 :] if 100 * len(x & y) >= num * len(x | y)}
    classes = brute.components(rows, n, num)
    assert len(want) > len(own) - len({classes[i] for i in first.values()}) + 20  # far more than connect
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(4)
    got = [(min(r["a"], r["b"]), max(r["a"], r["b"]), r["common"]) for r in jaccard_join.pairs(d, n, num).collect()]
    assert sorted(got) == sorted((*k, v) for k, v in want.items())
    counted = {r["doc_id"]: r for r in jaccard_join.links(d, n, num).collect()}
    assert len(counted) == len(rows) and {i: r["component_id"] for i, r in counted.items()} == classes
    for s, m in members.items():
        n_links = sum(first[s] in k for k in want)
        assert all((counted[i]["n_links"], counted[i]["n_equal"]) == (n_links, len(m) - 1) for i in m)
