"""The store: outcomes, replacing, loads and streams at the same time, folding and compacting."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from quire.operators import answers
from quire.sources import shared, store as store_module
from quire.sources.manifest import Manifest
from quire.sources.store import Store
from quire.streaming import events

TEXT = "A sentence with enough words to be kept as a chunk of its own. " * 4
DOCS = "id long, user_id string, file_name string, text string"


def docs_of(spark, ids, text=TEXT):
    return spark.createDataFrame([(i, "u", f"{i}.txt", text) for i in ids], DOCS)


def envelopes_of(spark, ids):
    of = lambda i: json.dumps({"payload": {"fileId": str(i), "url": "u", "mimeType": "text/plain"}})
    return spark.createDataFrame([(of(i),) for i in ids], "value string")


def loaded(store):
    return sorted(r["document_id"] for r in store.chunks().select("document_id").distinct().collect())


def test_store(spark):
    docs = spark.createDataFrame([(1, "u", "a.txt", TEXT), (2, "u", "b.txt", "short"), (3, "u", "c.txt", None), (1, "u", "a.txt", TEXT)], DOCS)
    s = Store(spark)
    assert s.status().count() == 0 and s.chunks().count() == 0 and s.vectors().count() == 0
    s.register(docs)
    assert {r["status"] for r in s.status().collect()} == {"PENDING"}
    s.load(docs)
    got = {r["document_id"]: (r["status"], r["chunk_count"], r["error_message"]) for r in s.status().collect()}
    assert got == {1: ("COMPLETED", 1, None), 2: ("FAILED", 0, "Text too short after cleaning: 5 chars"), 3: ("FAILED", 0, "Extracted text is empty")}
    assert s.chunks().count() == s.vectors().count() == 1
    s.load(docs.filter("id = 1").withColumn("text", F.concat("text", F.lit("new words. "), "text", "text", "text", "text", "text", "text")))
    m = s.chunks().count()
    assert m > 1 and s.vectors().count() == m and s.chunks().filter("chunk_text LIKE '%new words%'").count() >= 1
    assert {r["document_id"]: r["total_chunks"] for r in s.stats().collect()} == {1: m, 2: 0, 3: 0}
    s.load(docs.filter("id = 1"))
    assert s.chunks().count() == 1
    before = sorted(map(tuple, s.chunks().collect()))
    s.compact()
    assert sorted(map(tuple, s.chunks().collect())) == before and s.status().count() == 3 and len(s.manifest.last()[1]["data"]) == 1
    v = s.vectors().first()
    assert v["metadata"]["fileName"] == "a.txt" and v["id"] == "1-0" and sum(v["embedding"]) > 10
    stats = sorted(map(tuple, answers.chunk_stats(docs.select(F.col("id").alias("document_id")).distinct(), s.chunks()).collect()))
    assert stats == sorted(map(tuple, answers.averaged(s.stats()).collect())) and len(stats) == 3
    s.delete(docs.select(F.col("id").alias("document_id")).filter("document_id = 1"))
    assert s.chunks().count() == 0 and s.vectors().count() == 0 and s.status().count() == 2


def test_streams_and_loads_lose_nothing_of_each_other(spark):
    s = Store(spark)
    s.load(docs_of(spark, range(20)))
    texts = docs_of(spark, range(20, 60))
    events.etl_stream(envelopes_of(spark, range(20, 40)), texts, s)
    events.etl_stream(envelopes_of(spark, range(40, 61)), texts, s)  # another stream, with a checkpoint of its own
    assert loaded(s) == list(range(60)) and s.vectors().count() == 60
    assert [(r["document_id"], r["error_message"]) for r in s.status().filter("status = 'FAILED'").collect()] == [(60, "Document not found: 60")]
    s.compact()
    assert loaded(s) == list(range(60))


def test_writers_at_the_same_time(spark):
    path = shared.new_path(spark, "store")
    failures = []

    def writer(ids):
        try:
            Store(spark, path).load(docs_of(spark, ids))
        except Exception as e:  # noqa: BLE001
            failures.append(e)

    parts = [range(0, 10), range(10, 20), range(5, 15)]
    threads = [threading.Thread(target=writer, args=(p,)) for p in parts]
    threads.append(threading.Thread(target=lambda: events.etl_stream(envelopes_of(spark, range(18, 25)), docs_of(spark, range(30)), Store(spark, path))))
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    s = Store(spark, path)
    assert not failures and loaded(s) == list(range(25)) and s.vectors().count() == s.chunks().count() == 25
    assert s.manifest.last()[1]["load"] == 4


def test_a_micro_batch_that_is_run_again(spark):
    s = Store(spark)
    batch = events.etl(s, docs_of(spark, range(5)), "stream-a")
    batch(envelopes_of(spark, range(3)), 0)
    version = s.manifest.last()[0]
    batch(envelopes_of(spark, range(3)), 0)
    assert s.manifest.last()[0] == version and loaded(s) == [0, 1, 2]
    events.etl(s, docs_of(spark, range(5)), "stream-b")(envelopes_of(spark, [4]), 0)
    assert loaded(s) == [0, 1, 2, 4]


def test_readers_take_few_tables(spark, monkeypatch):
    monkeypatch.setattr(store_module, "FOLD", 3)
    s = Store(spark)
    s.load(docs_of(spark, range(4)))
    for i in range(6):
        s.register(docs_of(spark, [100 + i]))
    state = s.manifest.last()[1]
    assert len(state["status"]) <= 4
    for _ in range(4):
        s.begin(docs_of(spark, [0, 200]))
    assert s.status().count() == 11 and loaded(s) == [0, 1, 2, 3]


def test_a_load_that_fails_shows_nothing(spark):
    def embed(texts):
        raise ValueError("no model")

    s = Store(spark)
    s.load(docs_of(spark, [1]))
    with pytest.raises(Exception, match="no model"):
        Store(spark, s.path, embed).load(docs_of(spark, [1, 2], TEXT * 2))
    assert loaded(s) == [1] and {r["status"] for r in s.status().collect()} == {"PROCESSING"}  # the old chunks stay
    s.load(docs_of(spark, [1, 2]))
    assert loaded(s) == [1, 2]


def test_statistics_read_no_texts(spark):
    s = Store(spark)
    s.load(docs_of(spark, range(3)))
    plan = s.stats()._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk_text" not in plan and all("/status/" in f for f in s.stats().inputFiles())


def test_manifest(spark):
    m = Manifest(spark, shared.new_path(spark, "manifest"), {"n": 0})
    assert m.last() == (0, {"n": 0})

    def add(state):
        state["n"] += 1
        return state["n"]

    got = []
    threads = [threading.Thread(target=lambda: got.extend(m.commit(add) for _ in range(12))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(1, 49)) and m.last() == (48, {"n": 48})
    assert not shared.create_text(spark, f"{m.path}/{48:012d}.json", "other")
