import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import answers, embedding, search
from quire.sources import shared, tables
from quire.streaming import events


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (148, 39), (149, 40), (1136, 299), (1137, 300), (1900, 500), (1901, 501)])
def test_tokens(spark, n, want):
    assert one(spark, "x" * n, X.tokens_by_ratio) == want


def test_lengths_count_utf16_units(spark):
    assert one(spark, "a😀b", X.utf16_length) == 4
    assert one(spark, None, X.tokens_by_ratio) == 0


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"summary: Short title, details: x"}', "Short title"),
        ('SUMMARY: a "b" [c],', "a b c"),
        ("plain", "plain"),
        ('"quoted",', "quoted"),
    ],
)
def test_title(spark, raw, want):
    assert one(spark, raw, X.clean_title) == want


def test_answer(spark):
    assert one(spark, "Question: a\nConstraint: b\nyes\nFound in: c", X.clean_answer) == "yes\nFound in: c"


@pytest.mark.parametrize("mime,name,want", [("application/pdf", "x.txt", "pdf"), ("application/msword", None, "docx"), ("text/plain", "a.pdf", "txt"), (None, "b.MD", "txt"), (None, "c.doc", "docx"), ("image/png", "d", "pdf"), (None, None, "pdf")])
def test_types(spark, mime, name, want):
    df = spark.createDataFrame([(mime, name)], "m string, n string")
    assert df.select(X.type_of_upload(F.col("m"), F.col("n"))).first()[0] == want


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).round(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>").repartition(5)
    q = df.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    f = v.astype(np.float32).astype(np.float64)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    s = np.round(f @ f.T, 6)
    want = {(a, int(b), r + 1) for a in range(0, 300, 50) for r, b in enumerate(sorted((j for j in range(300) if s[a, j] >= 0.3), key=lambda j: (-s[a, j], j))[:4])}
    for block in (2, 1024):
        got = search.top_k_batch(df, q, 4, 0.3, block=block).collect()
        assert {(r["query_id"], r["id"], r["rank"]) for r in got} == want
    alone = search.top_k(df, q.filter("query_id = 50"), 4, 0.3).collect()
    assert [(r["id"]) for r in alone] == [b for _, b, _ in sorted((x for x in want if x[0] == 50), key=lambda x: x[2])]
    assert search.top_k_batch(df, q.limit(0)).count() == 0


def test_vectors_without_direction_are_no_hits(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, 0.0, 0.0]), (5, [2.0, 0.1]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(2)
    q = df.withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["id"]) for r in search.top_k_batch(df, q, 9, 0.5).collect()}
    assert got == {(a, b) for a in (2, 5) for b in (2, 5)} | {(4, 4)}
    same = df.filter("size(embedding) = 2 AND id != 6")
    assert [r["id"] for r in search.top_k(same, q.filter("query_id = 2"), 9, 0.5).collect()] == [2, 5]
    assert search.top_k(same, q.filter("query_id = 1"), 9, -1.0).count() == 0


def test_batch_search_in_small_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(200, 4)).round(2)
    df = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v)], "id string, embedding array<double>").coalesce(2)
    q = df.filter("id < 'v020'").withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, search.top_k_batch(df, q, 3, 0.0).collect()))
    assert len(want) == 60
    monkeypatch.setattr(search, "GROUP_NUMBERS", 40)
    assert sorted(map(tuple, search.top_k_batch(df, q, 3, 0.0, block=7).collect())) == want


def test_embedding(spark):
    df = spark.createDataFrame([(1, "One two\nTWO", 3), (2, None, 4), (3, "", 5)], "id long, t string, _text int")
    got = {r["id"]: (r["embedding"], r["_text"]) for r in embedding.embedded(df, "t").collect()}
    assert sum(got[1][0]) == 3 and max(got[1][0]) >= 2 and got[2] == ([0.0] * 64, 4) and got[3] == ([0.0] * 64, 5)
    own = embedding.embedded(df, "t", lambda texts: np.array([[len(t), 1] for t in texts])).collect()
    assert {r["id"]: r["embedding"] for r in own} == {1: [11.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    hits = search.top_k_text(embedding.embedded(df, "t"), spark.createDataFrame([(9, "two two one"), (8, "")], "query_id long, text string"), k=5, threshold=0.9).collect()
    assert [(r["query_id"], r["id"], r["rank"]) for r in hits] == [(9, 1, 1)]


def test_answer_model(spark):
    df = spark.createDataFrame([(1, "Thông tin:\n[Nguồn 1 — f > t]\nbody\n\nmore"), (2, "bad")], "query_id long, prompt string")
    plain = {r["query_id"]: json.loads(r["answer"]) for r in answers.answered(df).collect()}
    assert plain[1] == {"summary": "body", "details": [], "sources": ["Nguồn 1 — f > t"]}

    def model(prompts):
        if "bad" in prompts:
            raise ValueError
        return [str(len(p)) for p in prompts]

    got = {r["query_id"]: r["answer"] for r in answers.answered(df.repartition(2, "query_id"), model).collect()}
    assert got[2] is None


def test_subscription_goes_on_after_a_failure(spark, tmp_path):
    seen = []
    spark.createDataFrame([("x",)], "value string").write.text(str(tmp_path / "in"))

    def each(batch, number):
        seen.append(number)
        if len(seen) == 1:
            raise ValueError("once")

    stream = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    s = events.Subscription(stream, each, str(tmp_path / "c"), waits=(0.1,))
    s.run()
    assert seen == [0, 0]
    s.stop()
    with pytest.raises(Exception, match="once|twice"):
        events.Subscription(stream, lambda b, n: (_ for _ in ()).throw(ValueError("twice")), str(tmp_path / "d"), most=1, waits=(0.1,)).run()


def test_scratch(spark):
    with shared.scratch(spark):
        t = shared.written(spark.range(3), "t")
        assert t.count() == 3 and shared.exists(spark, t._quire_path)
    assert not shared.exists(spark, t._quire_path)


def test_errors_and_completion(spark):
    df = spark.createDataFrame([(1, "ab", "2024-01-01 00:00:00", "2024-01-01 00:00:02", False), (2, "x", "2024-01-01 00:00:00", "2024-01-01 00:00:02", True)], "stream_id long, answer string, a string, b string, failed boolean")
    df = df.withColumn("asked_at", F.col("a").cast("timestamp_ntz")).withColumn("answered_at", F.col("b").cast("timestamp_ntz"))
    got = {r["stream_id"]: r for r in answers.completed(df, F.col("failed")).collect()}
    assert (got[1]["content"], got[1]["response_time_ms"], got[1]["tokens_used"]) == ("ab", 2000, 1)
    assert got[2]["content"] == answers.AGENT_ERROR and got[2]["response_time_ms"] is None
    j = spark.range(1).select(answers.response(a=F.lit(0), b=F.lit(""), c=F.lit(None).cast("string"), d=F.lit("x"), e=F.lit(2)).alias("j")).first()["j"]
    assert json.loads(j) == {"d": "x", "e": 2}


def test_events(spark):
    rows = [
        json.dumps({"subject": "s", "payload": {"fileId": "1", "url": "u", "mimeType": "text/plain", "originalName": "a.txt", "userId": "7"}}),
        json.dumps({"fileId": "2", "url": "u", "mimeType": "application/pdf"}),
        json.dumps({"payload": {"fileId": "3", "url": "  ", "mimeType": "application/pdf"}}),
        json.dumps({"payload": {"fileId": "4", "url": "u", "mimeType": "image/png"}}),
        json.dumps({"payload": {"fileId": "5", "url": "u"}}),
        "not json",
        None,
    ]
    got = events.documents_of(spark.createDataFrame([(r,) for r in rows], "value string")).orderBy("file_id").collect()
    assert [(r["file_id"], r["user_id"], r["file_name"], r["document_type"]) for r in got] == [("1", "7", "a.txt", "txt"), ("2", "system", "document", "pdf")]


def test_token_stream(spark, tmp_path):
    rows = [(1, 1, "ab"), (1, 2, "c{d"), (1, 3, ""), (1, 4, "e{"), (2, 1, "none")]
    df = spark.createDataFrame(rows, "stream_id long, seq long, token string")
    assert {r["stream_id"]: r["answer"] for r in answers.from_first_brace(df).collect()} == {1: "{de{", 2: ""}
    df.coalesce(1).write.json(str(tmp_path / "in"))
    s = events.strip_prefix_stream(spark.readStream.schema(df.schema).json(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("stripped").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [(r["seq"], r["token"]) for r in spark.table("stripped").orderBy("seq").collect()] == [(2, "{d"), (4, "e{")]


def test_sync(spark):
    p = {"documentId": "d1", "title": "T", "chunks": [{"chunkId": "c1", "content": "x", "metadata": {"fileName": "own", "k": "v"}}, {"chunkId": "c2", "content": "y", "metadata": None}], "metadata": {"classification": "secret"}}
    got = {r["id"]: r["metadata"] for r in events.index_sync(spark.createDataFrame([(json.dumps(p),)], "value string")).collect()}
    assert got["c1"] == {"documentId": "d1", "classification": "secret", "fileName": "own", "k": "v"}
    assert got["c2"] == {"documentId": "d1", "fileName": "T", "classification": "secret"}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo\nworld", encoding="utf-8")
    (tmp_path / "b.bin").write_bytes(b"one|  |two")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in tables.files(spark, str(tmp_path / "a.txt")).collect()}
    assert got == {"a.txt": "héllo\nworld"}
    parts = tables.files(spark, str(tmp_path / "b.bin"), lambda c: c.decode().split("|")).first()["text"]
    assert parts == "one\n\ntwo\n\n"


def test_authorities(spark):
    df = spark.createDataFrame([("MEMBER", '["ORG_ADMIN", "X"]'), (None, None)], "r string, rs string").select(X.authorities(F.col("r"), F.col("rs")).alias("a"))
    base = "document:create,document:read,document:update,document:delete"
    assert [r["a"] for r in df.collect()] == [f"{base},ORG_ADMIN,X,ROLE_MEMBER,system:admin,kb:manage,user:manage", f"{base},ROLE_WORKSPACE_MEMBER"]


def test_normalize_against_plain_python(spark):
    """Texts with and without artefacts, at random; characters go without a lookup of each."""
    import random
    import re

    rng = random.Random(5)
    texts = ["".join(rng.choices("ab \n\n\n\r\t\x07\x1c\x7f\u00a0\ufeff\u200b\u200d\ufffdé😀", k=rng.randrange(30))) for _ in range(400)] + ["plain", "", None, "a\n\n\n\nb"]

    def plain(t, tabs):
        t = re.sub("\r\n?", "\n", t.replace("\ufeff", "")).replace("\u00a0", " ")
        t = re.sub("[\u200b\u200c\u200d\ufffd]", "", t.replace("\t", " ") if tabs else t)
        return re.sub("\n{4,}", "\n\n\n", re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t))

    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.normalize(F.col("t")).alias("a"), X.normalize(F.col("t"), tabs=False).alias("b"), X.utf16_length(F.col("t")).alias("n"), X.blank(F.col("t")).alias("blank"))
    for t, a, b, n, blank in d.collect():
        assert (a, b, n) == ((None,) * 3 if t is None else (plain(t, True), plain(t, False), len(t.encode("utf-16-le")) // 2))
        assert blank == (t is None or not t.strip(" \n\r\t\x1c"))
    assert "translate" not in d._jdf.queryExecution().toString()
