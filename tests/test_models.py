"""Models that fail, filters in words, memory with system messages, dead letters."""

import json

import pytest
from pyspark.sql import functions as F

from quire.operators import answers, models, search
from quire.sources.store import COLUMNS, Log, Store
from quire.streaming import events


def test_a_model_that_fails_every_third_call_answers_all_rows(spark):
    calls = {"n": 0}

    def model(texts):
        calls["n"] += 1
        if calls["n"] % 3 == 0:
            raise ConnectionError("busy")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, f"text {i} " * (i % 5)) for i in range(60)] + [(99, None)], "id long, t string").coalesce(1)
    got = {r["id"]: (r["reply"], r["error"]) for r in models.called(df, "t", model, most_tokens=20, wait=0.01).collect()}
    assert got == {i: (f"TEXT {i} " * (i % 5), None) for i in range(60)} | {99: (None, None)}


def test_one_bad_text_fails_alone(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("bad text")
        return [str(len(t)) for t in texts]

    df = spark.createDataFrame([("bad",), ("abc",), ("abcd",)], "t string").coalesce(1)
    got = {r["t"]: (r["reply"], r["error"]) for r in models.called(df, "t", model, tries=2, wait=0.01).collect()}
    assert got == {"bad": (None, "ValueError: bad text"), "abc": ("3", None), "abcd": ("4", None)}
    short = models.called(df, "t", lambda texts: ["x"], tries=1).filter("reply IS NULL").count()
    assert short == 0  # asked one by one, each has its one reply


def test_groups():
    assert list(models.groups(["a" * 38] * 5, 20)) == [[0, 1], [2, 3], [4]]
    assert list(models.groups(["a" * 380, "b"], 20)) == [[0], [1]] and list(models.groups([], 5)) == []


def test_replies_are_remembered(spark, tmp_path):
    def model(texts):
        with open(tmp_path / "asked", "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return [None if t == "no" else t + "!" for t in texts]

    cache = Log(spark, models.CACHE)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "no"), (5, None)], "id long, t string")
    for _ in range(2):
        got = {r["id"]: r["reply"] for r in models.remembered(df, "t", model, cache).collect()}
        assert got == {1: "a!", 2: "b!", 3: "a!", 4: None, 5: None}
    assert sorted((tmp_path / "asked").read_text().split()) == ["a", "b", "no", "no"]


def test_titles(spark):
    df = spark.createDataFrame([(1, "q one", "old"), (2, "fail", "old"), (3, "blank", "old")], "id long, first string, title string")

    def model(prompts):
        if any("fail" in p for p in prompts):
            raise ValueError
        return [' "" ' if "blank" in p else '{"summary: A title, details: x"}' for p in prompts]

    assert {r["id"]: r["title"] for r in answers.titled(df, model, tries=1).collect()} == {1: "A title", 2: "old", 3: "old"}


@pytest.mark.parametrize(
    "expression,want",
    [
        ("userId == 'a'", [1, 2]),
        ('userId == "a" && chunkIndex in ["0", "2"]', [1]),
        ("userId != 'a'", [3, 4, 5]),
        ("chunkIndex >= 1 || userId == 'it\\'s'", [2, 3, 4, 5]),
        ("not (chunkIndex < 1) and userId nin ['b']", [2, 4, 5]),
        ("missing == 'x'", []),
    ],
)
def test_metadata_filter(spark, expression, want):
    rows = [(1, {"userId": "a", "chunkIndex": "0"}), (2, {"userId": "a", "chunkIndex": "1"}), (3, {"userId": "b", "chunkIndex": "10"}), (4, {"userId": "it's", "chunkIndex": "7"}), (5, {"userId": "c", "chunkIndex": "1.5"}), (6, {"chunkIndex": "x"}), (7, None)]
    df = spark.createDataFrame(rows, "id long, metadata map<string,string>")
    if "not" in expression:
        rows = [r for r in rows if r[0] != 6]
        df = df.filter("id != 6")
    assert sorted(r["id"] for r in df.filter(search.metadata_filter(expression)).collect()) == want
    with pytest.raises(ValueError, match="not understood"):
        search.metadata_filter("userId == 'a' ; drop")


def test_files_without_a_value_are_left_out(spark):
    text = "A sentence with enough words to be kept as a chunk of its own. " * 4
    s = Store(spark)
    for user, ids in (("a", (1, 3)), ("b", (2, 4)), ("c", (1000, 5000))):
        s.load(spark.createDataFrame([(i, user, "f", text) for i in ids], "id long, user_id string, file_name string, text string").coalesce(1))
    found = s.vectors().filter(search.metadata_filter("documentId == '2' && userId == 'b'", COLUMNS))
    assert [r["document_id"] for r in found.collect()] == [2]
    paths = s.vectors().filter("user_id = 'b'")
    scan = paths._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,b)]" in scan or "EqualTo(user_id,b)" in scan


def test_system_messages_stay(spark):
    rows = [(1, 0, "system", 0), *[(1, i, "user", i) for i in range(1, 31)], *[(2, i, "user", i) for i in range(5)], (3, 0, "system", 0), (3, 1, "user", 1), (3, 2, "system", 2), (3, 3, "user", 3)]
    m = spark.createDataFrame(rows, "conversation_id long, id long, role string, created_at long")
    kept = lambda n: {c: sorted(r["id"] for r in answers.recent(m, n, keep_system=True).collect() if r["conversation_id"] == c) for c in (1, 2, 3)}
    assert kept(4) == {1: [0, 28, 29, 30], 2: [1, 2, 3, 4], 3: [1, 2, 3]}
    assert kept(1) == {1: [0], 2: [4], 3: [2]}


def test_dead_letters(spark, tmp_path):
    good = json.dumps({"payload": {"fileId": "1", "url": "u", "mimeType": "text/plain"}})
    rows = [(0, good), (1, good[:-3]), (2, None), (3, json.dumps({"fileId": "3", "url": " ", "mimeType": "text/plain"})), (4, json.dumps({"fileId": "4", "url": "u"})), (5, json.dumps({"fileId": "5", "url": "u", "mimeType": "image/png"}))]
    df = spark.createDataFrame(rows, "offset long, value string")
    stream, base = events.arriving(df, "letters", "parquet")
    ok, bad = events.split(stream, Log(spark, "offset long, value string, reason string"), f"{base}/c")
    assert [r["file_id"] for r in ok.collect()] == ["1"]
    assert {r["offset"]: r["reason"] for r in bad.collect()} == {1: "not JSON", 2: "not JSON", 3: "no address", 4: "no type", 5: "unsupported type: image/png"}
    assert ok.count() + bad.count() == len(rows) and bad.filter("offset = 1").first()["value"] == good[:-3]
    plain = events.documents_of(df)
    assert plain.count() == 1 and events.judged(df).filter(F.col("reason").isNull()).count() == 1
